"""Tracked tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.operators.lookups import with_task_timeout
from billspark.operators.sessions import micros


def with_elapsed(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Timeout of the type, seconds since the start (to the end where there is one), the flags."""
    out = with_task_timeout(tasks)
    end = F.coalesce(F.col("ended_at"), as_of)
    out = out.withColumn("elapsed_s", (micros(end) - micros(F.col("started_at"))) / 1_000_000)
    running = F.col("status") == "RUNNING"
    e, t = F.col("elapsed_s"), F.col("timeout_s")
    return out.withColumns(
        {
            "is_stuck": running & (e > t),
            "needs_recovery": running & (e > t * V.STUCK_FACTOR),
            "is_overrun": running & (e > t * V.OVERRUN_FACTOR),
        }
    )


def terminal_status(tasks: DataFrame) -> DataFrame:
    """The cause a task ended with: too late is TIMEOUT, recovered by the watchdog is RECOVERED."""
    late = F.col("elapsed_s") > F.col("timeout_s")
    rescued = F.col("elapsed_s") > F.col("timeout_s") * V.STUCK_FACTOR
    failed = F.col("status") == "FAILED"
    return tasks.withColumn(
        "final_status",
        F.when(failed & rescued, "RECOVERED").when(failed & late, "TIMEOUT").otherwise(F.col("status")),
    )


def task_health(tasks: DataFrame) -> DataFrame:
    """One row: counts by final status and whether the system is healthy."""
    s = F.col("final_status")
    active = F.count_if(s == "RUNNING")
    return tasks.agg(
        active.alias("active"),
        F.count_if(s == "COMPLETED").alias("completed"),
        F.count_if(s == "FAILED").alias("failed"),
        F.count_if(s == "TIMEOUT").alias("timeout"),
        F.count_if(s == "RECOVERED").alias("recovered"),
        ((active <= V.MAX_ACTIVE_TASKS) & (F.count_if("is_overrun") == 0)).alias("healthy"),
    )
