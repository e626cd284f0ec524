"""Extraction attempts and the choice among them.

A document has at most one attempt per registered strategy, so the arrays gathered per document
are as short as the list of strategies. Winners are picked with ``min_by``/``max_by``, which
combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.functions.text import strip
from billspark.session import materialize

GATE = 0.3
AGENT_MINIMUM, AGENT_GOOD = 0.4, 0.65
LOW_CONFIDENCE = "Low confidence extraction"
ALL_FAILED = "All extraction methods failed"


def passes_gate(threshold: float = GATE) -> Column:
    return F.col("success") & (F.col("confidence") >= threshold)


def union_attempts(parts: list[DataFrame]) -> DataFrame:
    """Attempts of several strategies as one table; attempt_no follows the list."""
    numbered = [p.withColumn("attempt_no", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def run_until_accepted(
    docs: DataFrame, strategies: list[Callable[[DataFrame], DataFrame]], key: str = "doc_id",
    threshold: float = GATE,
) -> DataFrame:
    """Strategies in order; each next one reads only the documents that none has passed yet.

    A rung's attempts are used twice, as output and as the list of documents that are done, so
    they are written once instead of being extracted twice.
    """
    parts, left = [], docs
    for i, strategy in enumerate(strategies):
        got = strategy(left)
        if i == len(strategies) - 1:
            parts.append(got)
            break
        got = materialize(got, "attempts")
        parts.append(got)
        left = left.join(got.filter(passes_gate(threshold)).select(key), key, "left_anti")
    return union_attempts(parts)


def select_attempt(
    attempts: DataFrame, key: str = "doc_id", payload: list[str] | None = None,
    threshold: float = GATE,
) -> DataFrame:
    """First attempt through the gate, else the most confident success above 0, else failure."""
    cols = ["attempt_no", "method", "confidence", *(payload or [])]
    row = F.struct(*cols)
    usable = F.col("success") & (F.col("confidence") > 0)
    step = F.struct("attempt_no", "error_message", F.coalesce("processing_time_ms", F.lit(0)).alias("ms"))
    grouped = attempts.groupBy(key).agg(
        F.min_by(row, F.when(passes_gate(threshold), F.col("attempt_no"))).alias("first"),
        F.max_by(row, F.when(usable, F.struct("confidence", -F.col("attempt_no")))).alias("best"),
        F.array_sort(F.collect_list(step)).alias("steps"),
    )
    passed = F.col("first").isNotNull()
    chosen = F.coalesce("first", "best")
    made = F.when(
        passed, F.filter("steps", lambda s: s["attempt_no"] <= F.col("first.attempt_no"))
    ).otherwise(F.col("steps"))
    errors = F.array_compact(F.transform("steps", lambda s: F.nullif(s["error_message"], F.lit(""))))
    errors = F.when(F.size(errors) > 0, errors).otherwise(F.array(F.lit(ALL_FAILED)))
    empty = F.array().cast("array<string>")
    return grouped.withColumn("made", made).select(
        key,
        chosen.isNotNull().alias("success"),
        *[chosen[c].alias(c if c != "method" else "best_method") for c in cols],
        F.size("made").alias("n_attempts"),
        F.aggregate("made", F.lit(0).cast("bigint"), lambda a, s: a + s["ms"]).alias("total_ms"),
        F.when(chosen.isNull(), errors).otherwise(empty).alias("errors"),
        F.when(~passed & chosen.isNotNull(), F.array(F.lit(LOW_CONFIDENCE)))
        .otherwise(empty).alias("warnings"),
    )


def only_attempt(attempts: DataFrame, key: str = "doc_id", payload: list[str] | None = None) -> DataFrame:
    """``select_attempt`` for documents whose one attempt passed: a projection, nothing is gathered."""
    empty = F.array().cast("array<string>")
    return attempts.select(
        key, F.lit(True).alias("success"), F.lit(0).alias("attempt_no"), F.col("method").alias("best_method"),
        "confidence", *(payload or []), F.lit(1).alias("n_attempts"),
        F.coalesce("processing_time_ms", F.lit(0)).cast("bigint").alias("total_ms"),
        empty.alias("errors"), empty.alias("warnings"),
    )


def healing_ladder(
    attempts: DataFrame, key: str = "doc_id", minimum: float = AGENT_MINIMUM
) -> DataFrame:
    """First attempt at or above the minimum; if none, the last one tried, flagged as failed.

    ``image_only`` attempts count only for image documents.
    """
    tried = attempts
    if "image_only" in attempts.columns:
        tried = attempts.filter(~F.col("image_only") | F.col("is_image"))
    row = F.struct("attempt_no", "method", "confidence")
    good = tried.groupBy(key).agg(
        F.min_by(row, F.when(F.col("confidence") >= minimum, F.col("attempt_no"))).alias("first"),
        F.max_by(row, "attempt_no").alias("last"),
    )
    got = F.coalesce("first", "last")
    return good.select(
        key, got["attempt_no"].alias("attempt_no"), got["method"].alias("method"),
        got["confidence"].alias("confidence"), F.col("first").isNull().alias("extraction_failed"),
    )


def best_quality_attempt(
    attempts: DataFrame, key: str = "doc_id", good: float = AGENT_GOOD,
    minimum: float = AGENT_MINIMUM, vision: str = "gpt4_vision",
) -> DataFrame:
    """Running best until one is good enough; vision counts only when the best is below minimum.

    The first attempt that is good enough beats all before it, so the stop and the best of the
    rest are two aggregates; no ordering within the group is needed.
    """
    row = F.struct("attempt_no", "method", "confidence")
    rank = F.struct("confidence", -F.col("attempt_no"))
    ok = F.col("error_message").isNull()
    plain = ok & (F.col("method") != vision)
    out = attempts.groupBy(key).agg(
        F.min_by(row, F.when(plain & (F.col("confidence") >= good), F.col("attempt_no"))).alias("stop"),
        F.max_by(row, F.when(plain, rank)).alias("best"),
        F.max_by(row, F.when(ok & (F.col("method") == vision), rank)).alias("vision"),
    )
    best = F.coalesce("stop", "best")
    weak = best.isNull() | (best["confidence"] < minimum)
    use_vision = weak & F.col("vision").isNotNull() & (
        best.isNull() | (F.col("vision.confidence") > best["confidence"])
    )
    got = F.when(use_vision, F.col("vision")).otherwise(best)
    return out.select(
        key, got["attempt_no"].alias("attempt_no"), got["method"].alias("method"),
        got["confidence"].alias("confidence"), F.col("stop").isNotNull().alias("stopped_early"),
    )


def longest_text(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Longest non-blank text among engines, the earlier engine on ties."""
    rank = F.struct(F.length("text"), -F.col("engine_rank"))
    blank = strip(F.col("text")) == ""
    return readings.groupBy(*keys).agg(
        F.max_by(F.struct("engine", "text"), F.when(~blank, rank)).alias("r")
    ).select(*keys, F.col("r.engine").alias("engine"), F.col("r.text").alias("text"))


def first_nonblank_text(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Text of the first engine in fixed order that read anything."""
    blank = strip(F.col("text")) == ""
    return readings.groupBy(*keys).agg(
        F.min_by(F.struct("engine", "text"), F.when(~blank, F.col("engine_rank"))).alias("r")
    ).select(*keys, F.col("r.engine").alias("engine"), F.col("r.text").alias("text"))


def fallback_pick(calls: DataFrame, key: str, max_tier: str | None = None) -> DataFrame:
    """First successful model by tier then priority; STATIC with the last error when all fail."""
    tiers = V.MODEL_TIERS[:-1]
    allowed = tiers if max_tier is None else tiers[: tiers.index(max_tier) + 1]
    rank = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    order = F.struct(rank, F.col("priority"), F.col("model"))
    inside = F.col("tier").isin(allowed)
    picked = calls.groupBy(key).agg(
        F.min_by(F.struct("model", "tier"), F.when(inside & F.col("ok"), order)).alias("w"),
        F.max_by("error", F.when(inside & ~F.col("ok"), order)).alias("last_error"),
    )
    failed = F.col("w").isNull()
    return picked.select(
        key,
        F.coalesce("w.model", F.lit("static_fallback")).alias("model_used"),
        F.coalesce("w.tier", F.lit("STATIC")).alias("tier"),
        (~failed).alias("success"),
        F.when(failed, F.coalesce("last_error", F.lit("All models failed"))).alias("error"),
    )


def strategy_ranks(spark: SparkSession) -> DataFrame:
    """(file kind, strategy, rank): fixed rows."""
    rows = [(k, s, i) for k, names in V.STRATEGY_ORDER.items() for i, s in enumerate(names)]
    return spark.createDataFrame(rows, "file_kind string, strategy string, rank int")


def untried_strategies(docs: DataFrame, tried: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, strategies of its kind that have not been tried, with their rank."""
    ranks = F.broadcast(strategy_ranks(docs.sparkSession))
    wanted = docs.select(key, "file_kind").join(ranks, "file_kind")
    return wanted.join(tried.select(key, "strategy"), [key, "strategy"], "left_anti")


def missing_strategies(tried: Column, file_kind: str | None = None) -> Column:
    names = [s for s, _, _ in V.STRATEGIES] if file_kind is None else V.STRATEGY_ORDER[file_kind]
    return F.array_except(F.array(*[F.lit(s) for s in names]), tried)


class Strategies:
    """Pluggable strategies: name -> (function from documents to attempts, cost tier, best for)."""

    def __init__(self):
        self.items: dict[str, tuple[Callable[[DataFrame], DataFrame], int, list[str]]] = {}

    def register(self, name, fn, cost_tier: int = 1, best_for: list[str] | None = None) -> None:
        self.items[name] = (fn, cost_tier, best_for or [])

    def ordered(self, tag: str | None = None) -> list[Callable[[DataFrame], DataFrame]]:
        """Cheapest first, those best for ``tag`` ahead of others of the same cost."""
        names = sorted(self.items, key=lambda n: (self.items[n][1], tag not in self.items[n][2]))
        return [self.items[n][0] for n in names]

    def run(self, docs: DataFrame, key: str = "doc_id", threshold: float = GATE) -> DataFrame:
        return run_until_accepted(docs, self.ordered(), key, threshold)
