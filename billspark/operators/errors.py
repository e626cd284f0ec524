"""Error classification (R1-R4, F1, A9, O4): ordered keyword rules, then lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.operators.lookups import (
    type_groups, type_policy, with_category_policy, with_fallback_and_message,
)

RETRY_FIELDS = ["is_retryable", "severity", "max_retries", "retry_delay_base"]


def _any_word(words: list[str], word_boundary: bool) -> str:
    body = "|".join(re.escape(w) if not w.isalnum() else w for w in words).replace("\\ ", " ")
    return rf"\b(?:{body})\b" if word_boundary else body


def _haystack(error_type: Column, message: Column) -> Column:
    # a line break keeps a keyword from matching across the two
    return F.concat_ws("\n", F.lower(error_type), F.lower(message))


def classify_category(error_type: Column, message: Column, word_boundary: bool = False) -> Column:
    """First of nine keyword groups found in the type or the message, else 'unknown'."""
    text = _haystack(error_type, message)
    out = None
    for category, words in V.CATEGORY_KEYWORDS:
        test = text.rlike(_any_word(words, word_boundary))
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise("unknown")


def _decision(retryable: bool, severity: str, retries: int, delay: float) -> Column:
    return F.struct(
        F.lit(retryable).alias("is_retryable"), F.lit(severity).alias("severity"),
        F.lit(retries).alias("max_retries"), F.lit(delay).alias("retry_delay_base"),
    )


def classify_retryable(error_type: Column, message: Column) -> Column:
    """Decision struct from keywords; null when no keyword speaks (the category decides)."""
    text = _haystack(error_type, message)
    out = F.when(
        text.rlike(_any_word(V.NON_RETRYABLE_KEYWORDS, False)), _decision(False, "HIGH", 0, 0.0)
    )
    for _, words, (severity, retries, delay) in V.RETRYABLE_KEYWORDS:
        out = out.when(text.rlike(_any_word(words, False)), _decision(True, severity, retries, delay))
    return out


class Classifiers:
    """Custom rules consulted before the keyword rules: (predicate, category, decision)."""

    def __init__(self):
        self.rules: list[tuple[Column, str, Column]] = []

    def register(
        self, predicate: Column, category: str, retryable: bool, severity: str, max_retries: int,
        delay: float,
    ) -> None:
        self.rules.append((predicate, category, _decision(retryable, severity, max_retries, delay)))

    def first(self, pick: str, default: Column) -> Column:
        out = default
        for predicate, category, decision in reversed(self.rules):
            value = F.lit(category) if pick == "category" else decision
            out = F.when(predicate, value).otherwise(out)
        return out


def classify_errors(
    errors: DataFrame, classifiers: Classifiers | None = None, word_boundary: bool = False
) -> DataFrame:
    """Category, retry decision, fallback strategy, user message and log level per error."""
    kind, message = F.col("error_type"), F.col("message")
    rules = classifiers or Classifiers()
    category = rules.first("category", classify_category(kind, message, word_boundary))
    out = errors.withColumn("category", category).withColumn(
        "_d", rules.first("decision", classify_retryable(kind, message))
    )
    out = with_category_policy(out)
    given = F.col("_d").isNotNull()
    for field, fallback in zip(
        RETRY_FIELDS, ["cat_retryable", "cat_severity", "cat_max_retries", "cat_base_delay"]
    ):
        out = out.withColumn(field, F.when(given, F.col("_d")[field]).otherwise(F.col(fallback)))
    out = out.drop("_d", "cat_retryable", "cat_severity", "cat_max_retries", "cat_base_delay")
    return with_fallback_and_message(out)


def classify_by_type(errors: DataFrame) -> DataFrame:
    """Severity and recoverability by exact type; a ``recoverable`` flag on the row overrides."""
    spark = errors.sparkSession
    out = errors.join(F.broadcast(type_policy(spark)), "error_type", "left").join(
        F.broadcast(type_groups(spark)), "error_type", "left"
    )
    flag = F.col("recoverable") if "recoverable" in errors.columns else F.lit(None).cast("boolean")
    return out.withColumns(
        {
            "severity": F.coalesce("type_severity", F.lit("MEDIUM")),
            "is_recoverable": F.coalesce(flag, F.col("type_recoverable"), F.lit(True)),
            "error_group": F.coalesce("error_group", F.lit("UNKNOWN")),
        }
    ).drop("type_severity", "type_recoverable")


def recent(df: DataFrame, order: list[Column], k: int, keys: list[str] | None = None) -> DataFrame:
    """Newest k rows overall, or per key (ranked before the shuffle, so hot keys stay cheap)."""
    if not keys:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(f"_rn <= {k}").drop("_rn")


def error_stats(errors: DataFrame, history: int = 100, show: int = 10) -> DataFrame:
    """Counts by type over the last ``history`` errors, and how many are among the newest few."""
    newest = [F.col("ts").desc(), F.col("error_id").desc()]
    kept = recent(errors.select("ts", "error_id", "error_type"), newest, history)
    # at most ``history`` rows from here on
    ranked = kept.withColumn("pos", F.row_number().over(Window.orderBy(*newest)))
    return ranked.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("n_errors"), F.count_if(F.col("pos") <= show).alias("n_recent")
    )
