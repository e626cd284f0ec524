"""Dead-letter items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.operators.retry import dlq_delay

# ---- fixed values: item states reached by each action ------------------------------------------
STATUS_OF_ACTION = {
    "enqueue": "PENDING", "processing_started": "PROCESSING", "scheduled_retry": "RETRYING",
    "success": "SUCCESS", "failed": "FAILED", "discarded": "DISCARDED", "manual_retry": "PENDING",
}


def is_ready_for_retry(as_of: Column) -> Column:
    return (
        F.col("status").isin("PENDING", "RETRYING")
        & (F.col("retry_count") < F.col("max_retries"))
        & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of))
    )


def dlq_query(
    items: DataFrame, status: str | None = None, operation_type: str | None = None,
    tags: list[str] | None = None,
) -> DataFrame:
    if status:
        items = items.filter(F.col("status") == status)
    if operation_type:
        items = items.filter(F.col("operation_type") == operation_type)
    if tags:
        items = items.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return items


def dlq_order(items: DataFrame) -> DataFrame:
    return items.orderBy("priority", "created_at", "id")


def _status() -> Column:
    action = F.col("action")
    out = F.lit(None).cast("string")
    for name, status in STATUS_OF_ACTION.items():
        out = F.coalesce(out, F.when(action == name, status))
    return out


def dlq_apply_events(events: DataFrame) -> DataFrame:
    """Current item per id from its actions; a manual retry resets the counters.

    Only aggregates that combine before the shuffle: last action, last reset, and the retries
    after it. Needs id, operation_type, ts, event_no, action, error, priority, max_retries.
    An item whose allowed retries are used up is FAILED, whether or not a ``failed`` action follows.
    """
    order = F.struct("ts", "event_no")
    resets = (
        events.filter(F.col("action") == "manual_retry")
        .groupBy("id")
        .agg(F.max(order).alias("reset"))
    )
    placed = events.withColumn("o", order).join(resets, "id", "left")
    counted = (F.col("action") == "scheduled_retry") & (
        F.col("reset").isNull() | (F.col("o") > F.col("reset"))
    )
    items = placed.groupBy("id").agg(
        F.min_by("operation_type", "o").alias("operation_type"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max_by(_status(), "o").alias("status"),
        F.count_if(counted).alias("retry_count"),
        F.max(F.when(counted, F.col("ts"))).alias("_retried_at"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("o"))).alias("last_error"),
        F.max("priority").alias("priority"),
        F.max("max_retries").alias("max_retries"),
        F.count(F.lit(1)).alias("n_events"),
    )
    wait = dlq_delay(F.col("retry_count") - 1)
    due = F.timestamp_micros(
        F.unix_micros(F.col("_retried_at").cast("timestamp")) + (wait * 1_000_000).cast("bigint")
    )
    spent = (F.col("status") == "RETRYING") & (F.col("retry_count") >= F.col("max_retries"))
    return items.withColumns(
        {
            "next_retry_at": F.when((F.col("retry_count") > 0) & ~spent, due),
            "status": F.when(spent, "FAILED").otherwise(F.col("status")),
        }
    ).drop("_retried_at")


def dlq_history(events: DataFrame) -> DataFrame:
    """Processing history, one row per action (an item's history has no bound, so no array)."""
    return events.select("id", "ts", "event_no", "action", _status().alias("status"), "error")


def next_action(ok: Column) -> Column:
    """What a handler's outcome leads to; the last allowed failure ends the item."""
    left = F.col("retry_count") + 1 < F.col("max_retries")
    return F.when(ok, "success").when(left, "scheduled_retry").otherwise("failed")


def dlq_without_handler(items: DataFrame, handlers: DataFrame) -> DataFrame:
    """Items nobody handles, as discarded. ``handlers``: the registered operation types."""
    return items.join(handlers, "operation_type", "left_anti").withColumn(
        "status", F.lit("DISCARDED")
    )


def dlq_with_handler(items: DataFrame, handlers: DataFrame) -> DataFrame:
    return items.join(handlers, "operation_type", "left_semi")


def dlq_stats(items: DataFrame) -> DataFrame:
    """Counts per status plus a total row (status null)."""
    return items.rollup("status").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("retry_count").alias("n_retries"),
        F.countDistinct("operation_type").alias("n_operation_types"),
    )


def dlq_cleanup(items: DataFrame, as_of: Column, max_age_days: int = 30) -> DataFrame:
    """Keeps all but finished items that were last touched before the cut-off."""
    done = F.col("status").isin("SUCCESS", "DISCARDED")
    cutoff = as_of - F.expr(f"INTERVAL {max_age_days} DAYS")
    return items.filter(~(done & (F.col("updated_at") < cutoff)))


def ttl_expire(rows: DataFrame, touched: str, as_of: Column, seconds: int = 86400) -> DataFrame:
    return rows.filter(F.col(touched) > as_of - F.expr(f"INTERVAL {seconds} SECONDS"))


def state_cleanup(states: DataFrame, as_of: Column, max_age_days: int = 30) -> DataFrame:
    return states.filter(F.col("updated_at") >= as_of - F.expr(f"INTERVAL {max_age_days} DAYS"))


def quarantine_split(
    rows: DataFrame, error: Column, operation_type: str, as_of: Column, payload: list[str],
    max_retries: int = 5, priority: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead-letter rows). ``error``: struct<error_type, error_message>, null when fine.

    Both sides are filters over one plan; persist the input if it is dear to recompute.
    """
    marked = rows.withColumn("_error", error)
    good = marked.filter(F.col("_error").isNull()).drop("_error")
    bad = marked.filter(F.col("_error").isNotNull()).select(
        *payload,
        F.lit(operation_type).alias("operation_type"),
        F.to_json(F.struct(*payload)).alias("payload"),
        F.col("_error.error_type").alias("error_type"),
        F.col("_error.error_message").alias("error_message"),
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("retry_count"),
        F.lit(max_retries).alias("max_retries"),
        F.lit(priority).alias("priority"),
        as_of.alias("created_at"),
    )
    return good, bad


def write_dlq(items: DataFrame, folder: str) -> None:
    items.write.mode("append").partitionBy("operation_type").parquet(folder)


def read_dlq(spark, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


class Handlers:
    """Operation type -> function from due items to the items with a boolean ``ok``."""

    def __init__(self):
        self.items: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, operation_type: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        self.items[operation_type] = fn

    def types(self, spark) -> DataFrame:
        return spark.createDataFrame([(k,) for k in self.items], "operation_type string")

    def process(self, due: DataFrame) -> DataFrame:
        """Next action of every due item: each type's handler, 'discarded' where there is none."""
        known = list(self.items)
        out = due.filter(~F.col("operation_type").isin(known)).withColumn("action", F.lit("discarded"))
        for kind, fn in self.items.items():
            done = fn(due.filter(F.col("operation_type") == kind))
            out = out.unionByName(
                done.withColumn("action", next_action(F.coalesce("ok", F.lit(False)))).drop("ok")
            )
        return out
