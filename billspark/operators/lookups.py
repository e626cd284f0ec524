"""Small fixed tables and the joins over them (J1-J5, P11). All have a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V


def category_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.CATEGORY_POLICY,
        "category string, cat_retryable boolean, cat_severity string, cat_max_retries int, "
        "cat_base_delay double",
    )


def fallback_strategies(spark: SparkSession) -> DataFrame:
    rows = [(c, r, yes if r else no) for c, yes, no in V.FALLBACK_STRATEGY for r in (True, False)]
    return spark.createDataFrame(
        rows, "category string, is_retryable boolean, fallback_strategy string"
    )


def recovery_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.RECOVERY_MESSAGE, "category string, is_retryable boolean, user_message string"
    )


def user_messages(spark: SparkSession) -> DataFrame:
    texts = {m[0]: m for m in V.USER_MESSAGES}
    emoji = dict(V.USER_MESSAGE_EMOJI)
    rows = [(c, t, *texts[k], emoji[k]) for c, t, k in V.USER_MESSAGE_KEYS]
    return spark.createDataFrame(
        rows,
        "category string, problem string, message_key string, message_category string, "
        "show_retry_button boolean, show_help_button boolean, follow_up string, text string, emoji string",
    )


def task_timeouts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.TASK_TIMEOUTS, "task_type string, timeout_s double")


def breaker_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.BREAKER_PRESETS,
        "preset string, failure_threshold int, recovery_s double, half_open_calls int, "
        "successes_to_close int",
    )


def retry_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.RETRY_POLICIES,
        "policy string, max_retries int, base_delay double, max_delay double, exp_base double",
    )


def type_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.TYPE_POLICY, "error_type string, type_severity string, type_recoverable boolean"
    )


def type_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.TYPE_GROUP, "error_type string, error_group string")


def with_category_policy(df: DataFrame) -> DataFrame:
    """Adds the policy of ``category``; an unknown category gets the row for 'unknown'."""
    known = F.broadcast(category_policy(df.sparkSession))
    default = {c[0]: c for c in V.CATEGORY_POLICY}["unknown"]
    out = df.join(known, "category", "left")
    return out.withColumns(
        {
            "cat_retryable": F.coalesce("cat_retryable", F.lit(default[1])),
            "cat_severity": F.coalesce("cat_severity", F.lit(default[2])),
            "cat_max_retries": F.coalesce("cat_max_retries", F.lit(default[3])),
            "cat_base_delay": F.coalesce("cat_base_delay", F.lit(default[4])),
        }
    )


def log_level(severity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, level in V.LOG_LEVEL.items():
        out = F.coalesce(out, F.when(severity == name, level))
    return F.coalesce(out, F.lit("WARNING"))


def with_fallback_and_message(df: DataFrame) -> DataFrame:
    """Adds strategy, user message and log level for (category, is_retryable)."""
    spark = df.sparkSession
    on = ["category", "is_retryable"]
    out = df.join(F.broadcast(fallback_strategies(spark)), on, "left").join(
        F.broadcast(recovery_messages(spark)), on, "left"
    )
    default = F.when(F.col("is_retryable"), V.RECOVERY_MESSAGE_DEFAULT[True]).otherwise(
        V.RECOVERY_MESSAGE_DEFAULT[False]
    )
    return out.withColumns(
        {
            "fallback_strategy": F.coalesce("fallback_strategy", F.lit("graceful_degradation")),
            "user_message": F.coalesce("user_message", default),
            "log_level": log_level(F.col("severity")),
        }
    )


def with_user_message(df: DataFrame) -> DataFrame:
    """Message row for (category, problem); the general one when there is none."""
    g = {m[0]: m for m in V.USER_MESSAGES}[V.USER_MESSAGE_DEFAULT]
    out = df.join(F.broadcast(user_messages(df.sparkSession)), ["category", "problem"], "left")
    known = F.col("message_key").isNotNull()
    return out.withColumns(
        {
            "message_category": F.when(known, F.col("message_category")).otherwise(g[1]),
            "show_retry_button": F.when(known, F.col("show_retry_button")).otherwise(g[2]),
            "show_help_button": F.when(known, F.col("show_help_button")).otherwise(g[3]),
            "text": F.when(known, F.col("text")).otherwise(g[5]),
            "emoji": F.when(known, F.col("emoji")).otherwise(dict(V.USER_MESSAGE_EMOJI)[V.USER_MESSAGE_DEFAULT]),
            "message_key": F.coalesce("message_key", F.lit(V.USER_MESSAGE_DEFAULT)),
        }
    )


def with_task_timeout(df: DataFrame) -> DataFrame:
    out = df.join(F.broadcast(task_timeouts(df.sparkSession)), "task_type", "left")
    return out.withColumn("timeout_s", F.coalesce("timeout_s", F.lit(V.TASK_TIMEOUT_DEFAULT)))


def with_breaker_preset(df: DataFrame) -> DataFrame:
    d = V.BREAKER_DEFAULT
    out = df.join(F.broadcast(breaker_presets(df.sparkSession)), "preset", "left")
    names = ["failure_threshold", "recovery_s", "half_open_calls", "successes_to_close"]
    return out.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(names, d)})


def with_retry_policy(df: DataFrame) -> DataFrame:
    out = df.join(F.broadcast(retry_policies(df.sparkSession)), "policy", "left")
    names = ["max_retries", "base_delay", "max_delay", "exp_base"]
    return out.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(names, V.RETRY_DEFAULT)})


def enabled_models(models: DataFrame, tier: str | None = None) -> DataFrame:
    """Enabled models by tier, then priority."""
    rank = F.array_position(F.array(*[F.lit(t) for t in V.MODEL_TIERS]), F.col("tier"))
    kept = models.filter("enabled")
    if tier is not None:
        kept = kept.filter(F.col("tier") == tier)
    return kept.withColumn("tier_rank", rank).orderBy("tier_rank", "priority")


def with_company_defaults(invoices: DataFrame, company: dict[str, str | None]) -> DataFrame:
    """Invoice company, else the configured one (J11): the default is one constant row."""
    default = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in company.items()])
    return invoices.withColumn("company", F.coalesce("company", default))
