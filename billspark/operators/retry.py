"""Backoff, schedules and retry statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DLQ_BASE_S, DLQ_MAX_S = 60.0, 3600.0


def backoff_delay(
    attempt: Column, base: Column, maximum: Column, exp_base: Column, jitter: str | None = None,
    key: Column | None = None,
) -> Column:
    """min(base * exp^attempt, max). Jitter comes from a hash of (key, attempt), never from rand().

    ``even``: plus or minus half; ``half``: between half and whole.
    """
    delay = F.least(base * F.pow(exp_base, attempt), maximum)
    if jitter is None:
        return delay
    unit = F.pmod(F.xxhash64(key, attempt), F.lit(1_000_000)) / F.lit(1_000_000.0)
    if jitter == "even":
        return F.greatest(F.lit(0.0), delay + delay * 0.5 * (unit * 2 - 1))
    return delay * (0.5 + unit * 0.5)


def dlq_delay(retry_count: Column) -> Column:
    return F.least(DLQ_BASE_S * F.pow(F.lit(2.0), retry_count), F.lit(DLQ_MAX_S))


def retry_schedule(operations: DataFrame, started: str = "ts") -> DataFrame:
    """One row per retry with its delay and due time; needs the policy columns and a start time.

    The delay sum is worked out inside each row, so there is no window and no shuffle.
    """
    steps = F.sequence(F.lit(0), F.col("max_retries") - 1)
    delay = lambda a: F.least(F.col("base_delay") * F.pow(F.col("exp_base"), a), F.col("max_delay"))
    rows = operations.filter("max_retries > 0").withColumn("attempt", F.explode(steps))
    waited = F.aggregate(
        F.sequence(F.lit(0), F.col("attempt")), F.lit(0.0), lambda acc, a: acc + delay(a)
    )
    return rows.withColumn("delay_s", delay(F.col("attempt"))).withColumn("waited_s", waited).withColumn(
        "due_at",
        (F.unix_micros(F.col(started).cast("timestamp")) + (F.col("waited_s") * 1_000_000).cast("bigint")),
    ).withColumn("due_at", F.timestamp_micros("due_at"))


def should_retry(
    attempt: Column, max_retries: Column, error_type: Column, deny: list[str] | None = None,
    allow: list[str] | None = None,
) -> Column:
    test = attempt < max_retries
    if deny:
        test = test & ~error_type.isin(deny)
    if allow:
        test = test & error_type.isin(allow)
    return test


def retry_stats(attempts: DataFrame, key: str = "operation") -> DataFrame:
    """Per operation: counts, waiting, span, distinct error types (a set, however many failures)."""
    kinds = attempts.filter(~F.col("ok")).select(key, "error_type").distinct()
    types = kinds.groupBy(key).agg(F.array_sort(F.collect_list("error_type")).alias("error_types"))
    stats = attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("ok").alias("successes"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.sum("wait_s").alias("total_wait_s"),
        F.max("ts").alias("last_attempt"),
        (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))).alias("span_us"),
    )
    empty = F.array().cast("array<string>")
    return stats.join(types, key, "left").withColumn("error_types", F.coalesce("error_types", empty))


def distinct_errors(errors: Column) -> Column:
    return F.array_sort(F.array_distinct(errors))
