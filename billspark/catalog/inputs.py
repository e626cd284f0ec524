"""Operational tables derived from ``events`` and ``lineitem``, as DataFrames and as SQL views.

The two forms of each input say the same thing; queries use the first, the comparison the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.catalog.sql_text import LINES, lit
from billspark.functions import fixed_values as V
from billspark.sources.tables import latest_lines, table

MESSAGES = [
    "429 too many requests", "read timeout", "401 unauthorized", "service unavailable",
    "load failed", "connection reset by peer", "pdf could not be rendered", "redis is down",
    "webhook callback lost", "session state lost", "user command unclear", "sheets quota exceeded",
    "out of credits", "plain trouble", "database maintenance", "download interrupted", "",
]
ERROR_TYPES = [
    "ConnectionError", "TimeoutError", "ValueError", "AIError", "PermissionError", "KeyError",
    "ServiceUnavailable", "DatabaseError", "OSError",
]
OPERATIONS = ["extract_fields", "render_invoice", "notify_client"]
TASK_TYPES = ["document_processing", "invoice_generation", "ai_extraction", "file_download", "cleanup"]
PROBLEMS = ["timeout", "rate_limit", "connection", "error", "failed", "ocr", "invalid"]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    return "[" + ", ".join(lit(v) for v in values) + f"][({index}) % {len(values)} + 1]"


def stamp(c: Column | str) -> Column:
    """Timestamps leave queries as text, so no session time zone gets between the engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(
        F.unix_micros(ts.cast("timestamp")) + F.round(seconds * 1_000_000).cast("bigint")
    )


def events(spark, sf_dir, *columns: str) -> DataFrame:
    """Events with ``k``, the number inside ``props``."""
    df = table(spark, sf_dir, "events")
    out = df.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn(
        "ok", F.col("event_type") != "error"
    )
    return out.select(*columns) if columns else out


EVENTS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  event_type <> 'error' AS ok FROM events)
"""


def errors(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("error_id"), "ts", "user_id",
        pick(ERROR_TYPES, F.col("user_id")).alias("error_type"),
        pick(MESSAGES, F.col("k")).alias("message"),
    )


ERRORS = f"""
{EVENTS},
errors AS (SELECT event_id AS error_id, ts, user_id, {sql_pick(ERROR_TYPES, "user_id")} AS error_type,
  {sql_pick(MESSAGES, "k")} AS message FROM ev)
"""


def outcomes(spark, sf_dir, service: Column | None = None) -> DataFrame:
    service = F.col("user_id").cast("string") if service is None else service
    return events(spark, sf_dir).select(service.alias("service"), "ts", "event_id", "ok")


def dlq_events(spark, sf_dir) -> DataFrame:
    t, k = F.col("event_type"), F.col("k")
    action = (
        F.when(t == "signup", "enqueue").when(t == "view", "processing_started")
        .when(t == "error", "scheduled_retry").when(t == "purchase", "success")
        .when(k < 20, "manual_retry").when(k < 40, "discarded").otherwise("failed")
    )
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("id"),
        pick(OPERATIONS, F.col("user_id")).alias("operation_type"),
        "ts", F.col("event_id").alias("event_no"), action.alias("action"),
        F.when(t == "error", pick(MESSAGES, k)).alias("error"),
        (F.col("user_id") % 10 + 1).cast("int").alias("priority"), F.lit(5).alias("max_retries"),
        F.array(pick(["urgent", "batch", "vip"], F.col("user_id")), F.lit("all")).alias("tags"),
    )


_ACTION_SQL = """CASE WHEN event_type = 'signup' THEN 'enqueue'
    WHEN event_type = 'view' THEN 'processing_started' WHEN event_type = 'error' THEN 'scheduled_retry'
    WHEN event_type = 'purchase' THEN 'success' WHEN k < 20 THEN 'manual_retry'
    WHEN k < 40 THEN 'discarded' ELSE 'failed' END"""

DLQ = f"""
{EVENTS},
dq AS (SELECT CAST(user_id AS VARCHAR) AS id, {sql_pick(OPERATIONS, "user_id")} AS operation_type, ts,
  event_id AS event_no, {_ACTION_SQL} AS action,
  CASE WHEN event_type = 'error' THEN {sql_pick(MESSAGES, "k")} END AS error,
  user_id % 10 + 1 AS priority, 5 AS max_retries,
  {sql_pick(["urgent", "batch", "vip"], "user_id")} AS tag FROM ev),
dq_reset AS (SELECT id, max(event_no) AS reset FROM dq WHERE action = 'manual_retry' GROUP BY id),
dq_item AS (
  SELECT dq.id, min(operation_type) AS operation_type, min(ts) AS created_at, max(ts) AS updated_at,
    arg_max(action, event_no) AS last_action, min(tag) AS tag,
    count(*) FILTER (WHERE action = 'scheduled_retry' AND (reset IS NULL OR event_no > reset)) AS retry_count,
    max(ts) FILTER (WHERE action = 'scheduled_retry' AND (reset IS NULL OR event_no > reset)) AS retried_at,
    arg_max(error, event_no) FILTER (WHERE error IS NOT NULL) AS last_error,
    max(priority) AS priority, max(max_retries) AS max_retries, count(*) AS n_events
  FROM dq LEFT JOIN dq_reset ON dq.id = dq_reset.id GROUP BY dq.id),
item AS (
  SELECT *, CASE WHEN last_action = 'scheduled_retry' AND retry_count >= max_retries THEN 'FAILED' ELSE
    CASE last_action WHEN 'enqueue' THEN 'PENDING' WHEN 'processing_started' THEN 'PROCESSING'
    WHEN 'scheduled_retry' THEN 'RETRYING' WHEN 'success' THEN 'SUCCESS' WHEN 'failed' THEN 'FAILED'
    WHEN 'discarded' THEN 'DISCARDED' WHEN 'manual_retry' THEN 'PENDING' END END AS status,
    CASE WHEN retry_count > 0 AND NOT (last_action = 'scheduled_retry' AND retry_count >= max_retries) THEN retried_at
      + to_seconds(CAST(least(60 * pow(2, retry_count - 1), 3600) AS BIGINT)) END AS next_retry_at
  FROM dq_item)
"""


def tasks(spark, sf_dir) -> DataFrame:
    t = F.col("event_type")
    ended = F.when(t.isin("purchase", "signup", "error"), plus_seconds(F.col("ts"), F.col("value")))
    status = (
        F.when(t == "error", "FAILED").when(t.isin("purchase", "signup"), "COMPLETED").otherwise("RUNNING")
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("task_id"), pick(TASK_TYPES, F.col("k")).alias("task_type"),
        F.col("ts").cast("timestamp").alias("started_at"), ended.alias("ended_at"),
        status.alias("status"), plus_seconds(F.col("ts"), F.col("value")).alias("seen_at"),
    )


_TIMEOUT_SQL = (
    "CASE task_type "
    + " ".join(f"WHEN {lit(n)} THEN {s}" for n, s in V.TASK_TIMEOUTS)
    + f" ELSE {V.TASK_TIMEOUT_DEFAULT} END"
)

TASKS = f"""
{EVENTS},
task0 AS (SELECT event_id AS task_id, {sql_pick(TASK_TYPES, "k")} AS task_type, value AS elapsed_s,
  CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type IN ('purchase', 'signup')
    THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM ev),
task AS (SELECT *, CAST({_TIMEOUT_SQL} AS DOUBLE) AS timeout_s FROM task0)
"""


def model_calls(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).select(
        F.floor(e / 4).alias("call_id"), "ts", "event_id",
        F.concat(F.lit("model-"), (F.col("k") % 6).cast("string")).alias("model"),
        pick(["north", "south"], F.col("k")).alias("provider"),
        pick(V.MODEL_TIERS[:-1], e).alias("tier"),
        (F.col("k") % 3).cast("int").alias("priority"),
        (F.col("event_type").isin("click", "view")).alias("ok"),
        F.col("value").alias("latency_ms"), (F.col("k") * 10).alias("tokens"),
        (F.col("k") * F.lit("0.003").cast("decimal(6,3)")).cast("decimal(18,3)").alias("cost"),
        F.concat(F.lit("error "), F.col("k").cast("string")).alias("error"),
    )


CALLS = f"""
{EVENTS},
calls AS (SELECT event_id // 4 AS call_id, ts, event_id, 'model-' || (k % 6) AS model,
  {sql_pick(["north", "south"], "k")} AS provider, {sql_pick(V.MODEL_TIERS[:-1], "event_id")} AS tier,
  k % 3 AS priority, event_type IN ('click', 'view') AS ok, value AS latency_ms, k * 10 AS tokens,
  k * 3 AS cost_m, 'error ' || k AS error FROM ev)
"""


def attempts(spark, sf_dir) -> DataFrame:
    """Attempts from order lines: (order, line) once, confidence from the discount."""
    failed = F.col("l_returnflag") == "R"
    conf = (F.round(F.col("l_discount") * 100) / 10).cast("double")
    return latest_lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("attempt_no"),
        pick([s for s, _, _ in V.STRATEGIES], F.col("l_partkey")).alias("method"),
        (~failed).alias("success"), F.when(failed, 0.0).otherwise(conf).alias("confidence"),
        F.when(failed, F.concat(F.lit("engine failed on "), F.col("l_suppkey").cast("string"))).alias(
            "error_message"
        ),
        F.col("l_quantity").cast("bigint").alias("processing_time_ms"),
        (F.col("l_orderkey") % 3 == 0).alias("is_image"),
        F.col("l_linenumber").isin(2, 3).alias("image_only"),
    )


ATTEMPTS = f"""
{LINES},
att AS (SELECT l_orderkey AS doc_id, l_linenumber AS attempt_no,
  {sql_pick([s for s, _, _ in V.STRATEGIES], "l_partkey")} AS method, l_returnflag <> 'R' AS success,
  CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE round(l_discount * 100)::DOUBLE / 10 END AS confidence,
  CASE WHEN l_returnflag = 'R' THEN 'engine failed on ' || l_suppkey END AS error_message,
  CAST(floor(l_quantity) AS BIGINT) AS ms, l_orderkey % 3 = 0 AS is_image, l_linenumber IN (2, 3) AS image_only
  FROM lines)
"""
