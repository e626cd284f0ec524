"""Model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.operators.slices import running_totals


def fallback_stats(calls: DataFrame) -> DataFrame:
    """One row over all calls; ``tier`` STATIC marks calls that ended in the static answer."""
    ok = F.col("ok")
    per_tier = [
        F.count_if(ok & (F.col("tier") == t)).alias(f"{t.lower()}_success") for t in V.MODEL_TIERS[:-1]
    ]
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"),
        *per_tier,
        F.count_if(F.col("tier") == "STATIC").alias("static_fallback"),
        F.count_if(~ok).alias("total_failures"),
        F.sum(F.when(ok, F.col("cost"))).alias("total_cost"),
        F.sum(F.when(ok, F.col("tokens"))).alias("total_tokens"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("avg_latency_ms"),
        F.max_by("model", F.when(ok, F.struct("ts", "call_id"))).alias("last_used_model"),
    )


def cost_usage(calls: DataFrame) -> DataFrame:
    """Tokens and cost per (provider, model), with subtotals and a total."""
    return calls.rollup("provider", "model").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")
    )


def running_latency(calls: DataFrame, key: str, order: list[str], **slicing) -> DataFrame:
    """Mean latency of the successes so far, per model or tier (few keys, so scanned in slices)."""
    good = calls.filter("ok")
    out = running_totals(
        good, [key], order,
        {"_sum": F.col("latency_ms"), "_n": F.lit(1).cast("bigint")}, **slicing,
    )
    return out.withColumn("running_latency_ms", F.col("_sum") / F.col("_n")).drop("_sum", "_n")
