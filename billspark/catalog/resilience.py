"""Queries over errors, retries, dead letters, breakers, tasks, sessions and model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from billspark.catalog import inputs as I
from billspark.catalog.registry import query
from billspark.catalog.sql_text import lit
from billspark.functions import fixed_values as V
from billspark.operators import breaker, dlq, errors, lookups, retry, sessions, tasks, usage

AS_OF_SQL = "TIMESTAMP '2024-01-25 00:00:00'"


def as_of():
    return F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")


# ---- errors -----------------------------------------------------------------------------------------

_HAY = "lower(error_type) || chr(10) || lower(message)"


def _has(words):
    return "(" + " OR ".join(f"contains({_HAY}, {lit(w)})" for w in words) + ")"


_CATEGORY = "CASE " + " ".join(f"WHEN {_has(w)} THEN {lit(c)}" for c, w in V.CATEGORY_KEYWORDS) + " ELSE 'unknown' END"
_KEYWORD = (
    f"CASE WHEN {_has(V.NON_RETRYABLE_KEYWORDS)} THEN 'no' "
    + " ".join(f"WHEN {_has(w)} THEN {lit(n)}" for n, w, _ in V.RETRYABLE_KEYWORDS)
    + " ELSE 'category' END"
)
_RULE_ROWS = ", ".join(
    ["('no', false, 'HIGH', 0, 0.0)"]
    + [f"({lit(n)}, true, {lit(s)}, {r}, {d})" for n, _, (s, r, d) in V.RETRYABLE_KEYWORDS]
)
_CAT_ROWS = ", ".join(f"({lit(c)}, {r}, {lit(s)}, {n}, {d})" for c, r, s, n, d in V.CATEGORY_POLICY)
_FALLBACK_ROWS = ", ".join(
    f"({lit(c)}, {lit(a)}, {lit(b)})" for c, a, b in V.FALLBACK_STRATEGY
)
_MESSAGE_ROWS = ", ".join(f"({lit(c)}, {r}, {lit(m)})" for c, r, m in V.RECOVERY_MESSAGE)
_CLASSIFIED = f"""
WITH {I.ERRORS},
tagged AS (SELECT *, {_CATEGORY} AS category, {_KEYWORD} AS rule FROM errors),
rules(rule, r, s, n, d) AS (VALUES {_RULE_ROWS}),
cats(category, r, s, n, d) AS (VALUES {_CAT_ROWS}),
fall(category, yes, nope) AS (VALUES {_FALLBACK_ROWS}),
msg(category, r, m) AS (VALUES {_MESSAGE_ROWS}),
decided AS (
  SELECT t.*, coalesce(u.r, c.r) AS is_retryable, coalesce(u.s, c.s) AS severity,
    coalesce(u.n, c.n) AS max_retries, coalesce(u.d, c.d) AS retry_delay_base
  FROM tagged t LEFT JOIN rules u ON t.rule = u.rule JOIN cats c ON t.category = c.category),
full_row AS (
  SELECT d.*, CASE WHEN is_retryable THEN f.yes ELSE f.nope END AS fallback_strategy,
    coalesce(m.m, CASE WHEN is_retryable THEN {lit(V.RECOVERY_MESSAGE_DEFAULT[True])}
      ELSE {lit(V.RECOVERY_MESSAGE_DEFAULT[False])} END) AS user_message,
    CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'HIGH' THEN 'ERROR' WHEN 'MEDIUM' THEN 'WARNING'
      WHEN 'LOW' THEN 'INFO' WHEN 'TRANSIENT' THEN 'DEBUG' END AS log_level
  FROM decided d JOIN fall f ON d.category = f.category
  LEFT JOIN msg m ON d.category = m.category AND d.is_retryable = m.r)
"""


@query("classify_category", f"WITH {I.ERRORS} SELECT error_id, {_CATEGORY} AS category FROM errors")
def classify_category(spark, sf_dir):
    return I.errors(spark, sf_dir).select(
        "error_id", errors.classify_category(F.col("error_type"), F.col("message")).alias("category")
    )


@query(
    "classify_retryable",
    f"""WITH {I.ERRORS}, tagged AS (SELECT *, {_KEYWORD} AS rule FROM errors),
    rules(rule, r, s, n, d) AS (VALUES {_RULE_ROWS})
    SELECT error_id, r AS is_retryable, s AS severity, CAST(n AS BIGINT) AS max_retries,
      CAST(d AS DOUBLE) AS delay FROM tagged LEFT JOIN rules USING (rule)""",
)
def classify_retryable(spark, sf_dir):
    d = errors.classify_retryable(F.col("error_type"), F.col("message"))
    return I.errors(spark, sf_dir).withColumn("d", d).select(
        "error_id", "d.is_retryable", "d.severity", F.col("d.max_retries").cast("bigint").alias("max_retries"),
        F.col("d.retry_delay_base").alias("delay"),
    )


@query(
    "classify_errors",
    _CLASSIFIED + """SELECT error_id, category, is_retryable, severity, CAST(max_retries AS BIGINT) AS max_retries,
    CAST(retry_delay_base AS DOUBLE) AS retry_delay_base, fallback_strategy, user_message, log_level FROM full_row""",
)
def classify_errors(spark, sf_dir):
    return errors.classify_errors(I.errors(spark, sf_dir)).select(
        "error_id", "category", "is_retryable", "severity",
        F.col("max_retries").cast("bigint").alias("max_retries"), "retry_delay_base",
        "fallback_strategy", "user_message", "log_level",
    )


@query(
    "custom_classifier",
    _CLASSIFIED + """SELECT error_id, CASE WHEN error_type = 'OSError' THEN 'file_download' ELSE category END AS category,
    CASE WHEN error_type = 'OSError' THEN true ELSE is_retryable END AS is_retryable,
    CAST(CASE WHEN error_type = 'OSError' THEN 7 ELSE max_retries END AS BIGINT) AS max_retries FROM full_row""",
)
def custom_classifier(spark, sf_dir):
    rules = errors.Classifiers()
    rules.register(F.col("error_type") == "OSError", "file_download", True, "LOW", 7, 1.5)
    return errors.classify_errors(I.errors(spark, sf_dir), rules).select(
        "error_id", "category", "is_retryable", F.col("max_retries").cast("bigint").alias("max_retries")
    )


@query(
    "error_policy_counts",
    _CLASSIFIED + """SELECT category, severity, is_retryable, count(*) AS n FROM full_row
    GROUP BY ALL""",
)
def error_policy_counts(spark, sf_dir):
    return (
        errors.classify_errors(I.errors(spark, sf_dir))
        .groupBy("category", "severity", "is_retryable").agg(F.count(F.lit(1)).alias("n"))
    )


_TYPES = ", ".join(f"({lit(t)}, {lit(s)}, {r})" for t, s, r in V.TYPE_POLICY)
_GROUPS = ", ".join(f"({lit(t)}, {lit(g)})" for t, g in V.TYPE_GROUP)


@query(
    "classify_by_type",
    f"""WITH {I.ERRORS}, p(error_type, s, r) AS (VALUES {_TYPES}), g(error_type, g) AS (VALUES {_GROUPS})
    SELECT error_id, coalesce(s, 'MEDIUM') AS severity, coalesce(r, true) AS is_recoverable,
      coalesce(g, 'UNKNOWN') AS error_group
    FROM errors LEFT JOIN p USING (error_type) LEFT JOIN g USING (error_type)""",
)
def classify_by_type(spark, sf_dir):
    return errors.classify_by_type(I.errors(spark, sf_dir)).select(
        "error_id", "severity", "is_recoverable", "error_group"
    )


_KEYS = ", ".join(f"({lit(c)}, {lit(t)}, {lit(k)})" for c, t, k in V.USER_MESSAGE_KEYS)
_EMOJI = dict(V.USER_MESSAGE_EMOJI)
_MSGS = ", ".join(
    f"({lit(k)}, {lit(c)}, {r}, {h}, {lit(t)}, {lit(_EMOJI[k])})" for k, c, r, h, _, t in V.USER_MESSAGES
)
_CATS = [c for c, _ in V.CATEGORY_KEYWORDS]


@query(
    "user_message_lookup",
    f"""WITH {I.EVENTS}, e AS (SELECT event_id, {I.sql_pick(_CATS, "k")} AS category,
      {I.sql_pick(I.PROBLEMS, "user_id")} AS problem FROM ev),
    ks(category, problem, key) AS (VALUES {_KEYS}), ms(key, mc, rb, hb, text, emoji) AS (VALUES {_MSGS})
    SELECT event_id, m.key AS message_key, mc AS message_category, rb AS show_retry_button,
      hb AS show_help_button, text, emoji
    FROM e LEFT JOIN ks USING (category, problem)
    JOIN ms m ON m.key = coalesce(ks.key, 'general_error')""",
)
def user_message_lookup(spark, sf_dir):
    e = I.events(spark, sf_dir).select(
        "event_id", I.pick(_CATS, F.col("k")).alias("category"),
        I.pick(I.PROBLEMS, F.col("user_id")).alias("problem"),
    )
    return lookups.with_user_message(e).select(
        "event_id", "message_key", "message_category", "show_retry_button", "show_help_button", "text", "emoji"
    )


@query(
    "error_stats",
    f"""WITH {I.ERRORS}, r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, error_id DESC) AS pos FROM errors)
    SELECT error_type, count(*) AS n_errors, count(*) FILTER (WHERE pos <= 10) AS n_recent
    FROM r WHERE pos <= 100 GROUP BY error_type""",
)
def error_stats(spark, sf_dir):
    return errors.error_stats(I.errors(spark, sf_dir))


@query(
    "recent_errors_per_user",
    f"""WITH {I.ERRORS} SELECT user_id, error_id FROM errors
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, error_id DESC) <= 10""",
)
def recent_errors_per_user(spark, sf_dir):
    newest = [F.col("ts").desc(), F.col("error_id").desc()]
    return errors.recent(I.errors(spark, sf_dir), newest, 10, ["user_id"]).select("user_id", "error_id")


# ---- retries -------------------------------------------------------------------------------------------

_POLICIES = [p[0] for p in V.RETRY_POLICIES] + ["other"]
_POLICY_ROWS = ", ".join(str(p) for p in [*V.RETRY_POLICIES, ("other", *V.RETRY_DEFAULT)])
_RETRY_SQL = f"""
WITH {I.EVENTS}, pol(policy, max_retries, base_delay, max_delay, exp_base) AS (VALUES {_POLICY_ROWS}),
op AS (SELECT event_id, ts, pol.* FROM ev JOIN pol ON pol.policy = {I.sql_pick(_POLICIES, "k")}),
step AS (SELECT op.*, a AS attempt, CAST(least(base_delay * pow(exp_base, a), max_delay) AS DOUBLE) AS delay_s
  FROM op, range(0, 5) t(a) WHERE a < max_retries)
"""


def _operations(spark, sf_dir):
    ops = I.events(spark, sf_dir).select("event_id", "ts", I.pick(_POLICIES, F.col("k")).alias("policy"))
    return lookups.with_retry_policy(ops)


@query(
    "retry_schedule",
    _RETRY_SQL + f"""SELECT event_id, attempt, delay_s, waited_s,
      {I.sql_stamp("ts + to_microseconds(CAST(waited_s * 1000000 AS BIGINT))")} AS due_at
    FROM (SELECT *, sum(delay_s) OVER (PARTITION BY event_id ORDER BY attempt) AS waited_s FROM step)""",
)
def retry_schedule(spark, sf_dir):
    return retry.retry_schedule(_operations(spark, sf_dir)).select(
        "event_id", F.col("attempt").cast("bigint").alias("attempt"), "delay_s", "waited_s",
        I.stamp("due_at").alias("due_at"),
    )


@query(
    "backoff_delay",
    _RETRY_SQL + """SELECT event_id, CAST(least(base_delay * pow(exp_base, event_id % 8), max_delay) AS DOUBLE) AS delay_s,
    true AS jitter_in_bounds FROM op""",
)
def backoff_delay(spark, sf_dir):
    args = (F.col("base_delay"), F.col("max_delay"), F.col("exp_base"))
    n = F.col("event_id") % 8
    plain = retry.backoff_delay(n, *args)
    even = retry.backoff_delay(n, *args, jitter="even", key=F.col("event_id"))
    half = retry.backoff_delay(n, *args, jitter="half", key=F.col("event_id"))
    inside = even.between(plain * 0.5, plain * 1.5) & half.between(plain * 0.5, plain)
    return _operations(spark, sf_dir).select(
        "event_id", plain.alias("delay_s"), inside.alias("jitter_in_bounds")
    )


@query(
    "should_retry",
    f"""WITH {I.ERRORS} SELECT error_id, error_id % 6 < 4 AND error_type NOT IN ('ValueError', 'KeyError')
      AND error_type IN ('ConnectionError', 'TimeoutError', 'OSError', 'ValueError') AS retry FROM errors""",
)
def should_retry(spark, sf_dir):
    return I.errors(spark, sf_dir).select(
        "error_id",
        retry.should_retry(
            F.col("error_id") % 6, F.lit(4), F.col("error_type"), ["ValueError", "KeyError"],
            ["ConnectionError", "TimeoutError", "OSError", "ValueError"],
        ).alias("retry"),
    )


@query(
    "retry_stats",
    f"""WITH {I.EVENTS}, a AS (SELECT {I.sql_pick(I.OPERATIONS, "user_id")} AS operation, ts, ok, k,
      CASE WHEN NOT ok THEN {I.sql_pick(I.ERROR_TYPES, "user_id")} END AS error_type FROM ev)
    SELECT operation, count(*) AS attempts, count(*) FILTER (WHERE ok) AS successes,
      count(*) FILTER (WHERE NOT ok) AS failures, CAST(sum(k) AS DOUBLE) AS total_wait_s,
      {I.sql_stamp("max(ts)")} AS last_attempt, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us,
      array_to_string(list_sort(list_distinct(list(error_type))), ',') AS error_types
    FROM a GROUP BY operation""",
)
def retry_stats(spark, sf_dir):
    ok = F.col("ok")
    a = I.events(spark, sf_dir).select(
        I.pick(I.OPERATIONS, F.col("user_id")).alias("operation"), "ts", "ok",
        F.col("k").cast("double").alias("wait_s"),
        F.when(~ok, I.pick(I.ERROR_TYPES, F.col("user_id"))).alias("error_type"),
    )
    return retry.retry_stats(a).withColumns(
        {"last_attempt": I.stamp("last_attempt"), "error_types": F.array_join("error_types", ",")}
    )


# ---- dead letters ------------------------------------------------------------------------------------------


def _items(spark, sf_dir):
    e = I.dlq_events(spark, sf_dir)
    tags = e.groupBy("id").agg(F.min("tags").alias("tags"))
    return dlq.dlq_apply_events(e).join(tags, "id")


@query(
    "dlq_items",
    f"""WITH {I.DLQ} SELECT id, operation_type, status, retry_count, last_error, n_events,
      {I.sql_stamp("created_at")} AS created_at, {I.sql_stamp("updated_at")} AS updated_at,
      {I.sql_stamp("next_retry_at")} AS next_retry_at FROM item""",
)
def dlq_items(spark, sf_dir):
    return dlq.dlq_apply_events(I.dlq_events(spark, sf_dir)).select(
        "id", "operation_type", "status", "retry_count", "last_error", "n_events",
        *[I.stamp(c).alias(c) for c in ("created_at", "updated_at", "next_retry_at")],
    )


@query("dlq_history", f"WITH {I.DLQ} SELECT id, event_no, action, error FROM dq")
def dlq_history(spark, sf_dir):
    return dlq.dlq_history(I.dlq_events(spark, sf_dir)).select("id", "event_no", "action", "error")


@query(
    "dlq_ready_for_retry",
    f"""WITH {I.DLQ} SELECT id, priority FROM item WHERE status IN ('PENDING', 'RETRYING')
      AND retry_count < max_retries AND (next_retry_at IS NULL OR next_retry_at <= {AS_OF_SQL})""",
)
def dlq_ready(spark, sf_dir):
    return dlq.dlq_order(_items(spark, sf_dir).filter(dlq.is_ready_for_retry(as_of()))).select(
        "id", F.col("priority").cast("bigint").alias("priority")
    )


@query(
    "dlq_filtered",
    f"""WITH {I.DLQ} SELECT id, status FROM item WHERE status = 'RETRYING'
      AND operation_type = 'extract_fields' AND tag IN ('urgent', 'vip')""",
)
def dlq_filtered(spark, sf_dir):
    return dlq.dlq_query(
        _items(spark, sf_dir), "RETRYING", "extract_fields", ["urgent", "vip"]
    ).select("id", "status")


@query(
    "dlq_stats",
    f"""WITH {I.DLQ} SELECT status, count(*) AS n_items, CAST(sum(retry_count) AS BIGINT) AS n_retries,
      count(DISTINCT operation_type) AS n_operation_types FROM item GROUP BY ROLLUP (status)""",
)
def dlq_stats(spark, sf_dir):
    return dlq.dlq_stats(dlq.dlq_apply_events(I.dlq_events(spark, sf_dir)))


@query(
    "dlq_cleanup",
    f"""WITH {I.DLQ} SELECT id, status FROM item WHERE NOT (status IN ('SUCCESS', 'DISCARDED')
      AND updated_at < {AS_OF_SQL} - INTERVAL 3 DAY)""",
)
def dlq_cleanup(spark, sf_dir):
    items = dlq.dlq_apply_events(I.dlq_events(spark, sf_dir))
    return dlq.dlq_cleanup(items, as_of(), 3).select("id", "status")


def _handlers(spark):
    return spark.createDataFrame([("extract_fields",), ("render_invoice",)], "operation_type string")


@query(
    "dlq_without_handler",
    f"""WITH {I.DLQ} SELECT id, operation_type, 'DISCARDED' AS status FROM item
      WHERE operation_type NOT IN ('extract_fields', 'render_invoice')""",
)
def dlq_without_handler(spark, sf_dir):
    items = dlq.dlq_apply_events(I.dlq_events(spark, sf_dir))
    return dlq.dlq_without_handler(items, _handlers(spark)).select("id", "operation_type", "status")


@query(
    "dlq_with_handler",
    f"""WITH {I.DLQ} SELECT id, operation_type FROM item
      WHERE operation_type IN ('extract_fields', 'render_invoice')""",
)
def dlq_with_handler(spark, sf_dir):
    items = dlq.dlq_apply_events(I.dlq_events(spark, sf_dir))
    return dlq.dlq_with_handler(items, _handlers(spark)).select("id", "operation_type")


@query(
    "dlq_handlers",
    f"""WITH {I.DLQ} SELECT id, CASE WHEN operation_type = 'notify_client' THEN 'discarded'
      WHEN operation_type = 'extract_fields' AND priority <= 5 THEN 'success'
      WHEN retry_count + 1 < max_retries THEN 'scheduled_retry' ELSE 'failed' END AS action FROM item""",
)
def dlq_handlers(spark, sf_dir):
    handlers = dlq.Handlers()
    handlers.register("extract_fields", lambda d: d.withColumn("ok", F.col("priority") <= 5))
    handlers.register("render_invoice", lambda d: d.withColumn("ok", F.lit(False)))
    items = dlq.dlq_apply_events(I.dlq_events(spark, sf_dir))
    return handlers.process(items).select("id", "action")


_SPLIT = """SELECT o_orderkey, 'ValueError' AS error_type, 'total out of range' AS error_message,
  'PENDING' AS status FROM orders WHERE o_totalprice > 400000
  UNION ALL SELECT o_orderkey, NULL, NULL, 'good' FROM orders WHERE o_totalprice <= 400000 OR o_totalprice IS NULL"""


@query("quarantine_split", _SPLIT)
def quarantine_split(spark, sf_dir):
    from billspark.sources.tables import table

    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    problem = F.when(
        F.col("o_totalprice") > 400000,
        F.struct(F.lit("ValueError").alias("error_type"), F.lit("total out of range").alias("error_message")),
    )
    good, bad = dlq.quarantine_split(rows, problem, "store_invoice", as_of(), ["o_orderkey", "o_totalprice"])
    none = F.lit(None).cast("string")
    passed = good.select("o_orderkey", none.alias("error_type"), none.alias("error_message"), F.lit("good").alias("status"))
    return bad.select("o_orderkey", "error_type", "error_message", "status").unionByName(passed)


# ---- breakers -------------------------------------------------------------------------------------------------


def _breaker_sql(service: str, f: int, wait_us: int, half: int, close: int, tail: str) -> str:
    """The fold as a recursive query: one step per call of every service."""
    return f"""
WITH RECURSIVE {I.EVENTS},
seq AS (SELECT {service} AS service, ts, event_id, ok, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY {service} ORDER BY ts, event_id) AS n FROM ev),
walk AS (
  SELECT service, 0::BIGINT AS n, 'CLOSED' AS st, 0::BIGINT AS cf, 0::BIGINT AS opened, 0::BIGINT AS calls,
    0::BIGINT AS good, true AS allowed, false AS chg, 'CLOSED' AS before, 0::BIGINT AS event_id, true AS ok
  FROM (SELECT DISTINCT service FROM seq)
  UNION ALL
  SELECT service, n,
    CASE WHEN NOT allowed THEN st
      WHEN st = 'CLOSED' THEN CASE WHEN NOT ok AND cf + 1 >= {f} THEN 'OPEN' ELSE 'CLOSED' END
      WHEN NOT ok THEN 'OPEN' WHEN good0 + 1 >= {close} THEN 'CLOSED' ELSE 'HALF_OPEN' END AS st,
    CASE WHEN NOT allowed THEN cf WHEN ok THEN 0 WHEN st = 'CLOSED' THEN cf + 1 ELSE 0 END AS cf,
    CASE WHEN allowed AND NOT ok AND (st <> 'CLOSED' OR cf + 1 >= {f}) THEN t ELSE opened END AS opened,
    CASE WHEN NOT allowed THEN calls WHEN st = 'OPEN' THEN 0 ELSE calls + 1 END AS calls,
    CASE WHEN NOT allowed THEN good WHEN ok THEN good0 + 1 ELSE 0 END AS good,
    allowed,
    allowed AND ((st = 'CLOSED' AND NOT ok AND cf + 1 >= {f})
      OR (st <> 'CLOSED' AND (NOT ok OR good0 + 1 >= {close}))) AS chg,
    st AS before, event_id, ok
  FROM (
    SELECT s.service, s.n, w.st, w.cf, w.opened, w.calls, s.t, s.ok, s.event_id, w.good,
      CASE WHEN w.st = 'HALF_OPEN' THEN w.good ELSE 0 END AS good0,
      CASE w.st WHEN 'CLOSED' THEN true WHEN 'OPEN' THEN s.t - w.opened >= {wait_us}
        ELSE w.calls < {half} END AS allowed
    FROM walk w JOIN seq s ON s.service = w.service AND s.n = w.n + 1))
{tail}"""


_TIMELINE = """SELECT service, event_id, ok, allowed, before AS state_before, st AS state_after,
  chg AS state_change FROM walk WHERE n > 0"""
_PER_USER = breaker.Breaker(2, 43200.0, 2, 2)
_HOT = breaker.Breaker(2, 900.0, 2, 2)


def _timeline(spark, sf_dir, machine, service=None, rows_per_slice=breaker.ROWS_PER_SLICE):
    return breaker.breaker_timeline(I.outcomes(spark, sf_dir, service), machine, rows_per_slice)


_SHOWN = ["service", "event_id", "ok", "allowed", "state_before", "state_after", "state_change"]


@query("breaker_timeline", _breaker_sql("CAST(user_id AS VARCHAR)", 2, 43_200_000_000, 2, 2, _TIMELINE))
def breaker_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir, _PER_USER).select(*_SHOWN)


@query("breaker_timeline_hot_service", _breaker_sql("'svc' || (user_id % 3)", 2, 900_000_000, 2, 2, _TIMELINE))
def breaker_timeline_hot(spark, sf_dir):
    service = F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string"))
    return _timeline(spark, sf_dir, _HOT, service).select(*_SHOWN)


@query(
    "breaker_stats",
    _breaker_sql(
        "CAST(user_id AS VARCHAR)", 2, 43_200_000_000, 2, 2,
        """SELECT service, count(*) FILTER (WHERE NOT ok AND allowed) AS failures,
        count(*) FILTER (WHERE ok AND allowed) AS successes, count(*) FILTER (WHERE NOT allowed) AS rejected,
        count(*) FILTER (WHERE chg) AS state_changes, arg_max(st, n) AS state
        FROM walk WHERE n > 0 GROUP BY service""",
    ),
)
def breaker_stats(spark, sf_dir):
    return breaker.breaker_stats(_timeline(spark, sf_dir, _PER_USER)).drop("last_opened_at")


@query(
    "breaker_changes",
    _breaker_sql(
        "CAST(user_id AS VARCHAR)", 2, 43_200_000_000, 2, 2,
        "SELECT service, event_id, before AS old_state, st AS new_state FROM walk WHERE chg",
    ),
)
def breaker_changes(spark, sf_dir):
    return breaker.breaker_changes(_timeline(spark, sf_dir, _PER_USER)).drop("ts")


def _leaky_sql(service: str, f: int, wait_us: int, half: int) -> str:
    return f"""
WITH RECURSIVE {I.EVENTS},
seq AS (SELECT {service} AS service, event_id, ok, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY {service} ORDER BY ts, event_id) AS n FROM ev),
walk AS (
  SELECT service, 0::BIGINT AS n, 'CLOSED' AS st, 0::BIGINT AS x, 0::BIGINT AS opened, true AS allowed,
    0::BIGINT AS event_id FROM (SELECT DISTINCT service FROM seq)
  UNION ALL
  SELECT service, n,
    CASE WHEN NOT allowed THEN st
      WHEN st = 'CLOSED' THEN CASE WHEN NOT ok AND x + 1 >= {f} THEN 'OPEN' ELSE 'CLOSED' END
      WHEN NOT ok THEN 'OPEN' WHEN good0 + 1 >= {half} THEN 'CLOSED' ELSE 'HALF_OPEN' END AS st,
    CASE WHEN NOT allowed THEN x
      WHEN st = 'CLOSED' THEN CASE WHEN ok THEN greatest(x - 1, 0) ELSE x + 1 END
      WHEN NOT ok THEN 0 WHEN good0 + 1 >= {half} THEN 0 ELSE good0 + 1 END AS x,
    CASE WHEN allowed AND NOT ok THEN t ELSE opened END AS opened, allowed, event_id
  FROM (SELECT s.service, s.n, w.st, w.x, w.opened, s.t, s.ok, s.event_id,
      CASE WHEN w.st = 'HALF_OPEN' THEN w.x ELSE 0 END AS good0,
      CASE w.st WHEN 'OPEN' THEN s.t - w.opened >= {wait_us} ELSE true END AS allowed
    FROM walk w JOIN seq s ON s.service = w.service AND s.n = w.n + 1))
SELECT service, event_id, allowed, st AS state_after FROM walk WHERE n > 0"""


@query("breaker_timeline_leaky", _leaky_sql("CAST(user_id AS VARCHAR)", 3, 86_400_000_000, 3))
def breaker_timeline_leaky(spark, sf_dir):
    machine = breaker.LeakyBreaker(3, 86400.0, 3)
    return _timeline(spark, sf_dir, machine).select("service", "event_id", "allowed", "state_after")


_PRESETS = [p[0] for p in V.BREAKER_PRESETS] + ["other"]
_PRESET_ROWS = ", ".join(str(p) for p in [*V.BREAKER_PRESETS, ("other", *V.BREAKER_DEFAULT)])


@query(
    "breaker_presets",
    f"""WITH {I.EVENTS}, p(preset, failure_threshold, recovery_s, half_open_calls, successes_to_close)
      AS (VALUES {_PRESET_ROWS})
    SELECT preset, count(*) AS n_calls, CAST(max(failure_threshold) AS BIGINT) AS failure_threshold,
      CAST(max(recovery_s) AS DOUBLE) AS recovery_s
    FROM ev JOIN p ON p.preset = {I.sql_pick(_PRESETS, "k")} GROUP BY preset""",
)
def breaker_presets(spark, sf_dir):
    calls = I.events(spark, sf_dir).select(I.pick(_PRESETS, F.col("k")).alias("preset"))
    return lookups.with_breaker_preset(calls).groupBy("preset").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.max("failure_threshold").cast("bigint").alias("failure_threshold"),
        F.max("recovery_s").alias("recovery_s"),
    )


# ---- runs, sessions ---------------------------------------------------------------------------------------------

_RUNS = f"""
WITH {I.EVENTS}, o AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS good,
    sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS bad FROM ev
  WINDOW w AS (PARTITION BY {{key}} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN ok THEN 0 ELSE count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY {{key}}, good ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS consecutive_failures,
  CASE WHEN ok THEN count(*) FILTER (WHERE ok) OVER (PARTITION BY {{key}}, bad ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS consecutive_successes
FROM o"""


@query("consecutive_runs", _RUNS.format(key="user_id % 2"))
def consecutive_runs(spark, sf_dir):
    service = (F.col("user_id") % 2).cast("string")
    return sessions.consecutive_runs(
        I.outcomes(spark, sf_dir, service), "service", ["ts", "event_id"]
    ).select("event_id", "consecutive_failures", "consecutive_successes")


@query(
    "retry_to_error",
    "SELECT event_id, consecutive_failures AS retry_count, consecutive_failures >= 3 OR "
    "(consecutive_failures > 0 AND user_id % 7 = 0) AS to_error FROM ("
    + _RUNS.format(key="user_id") + ") JOIN events USING (event_id)",
)
def retry_to_error(spark, sf_dir):
    e = I.events(spark, sf_dir).withColumn("recoverable", F.col("user_id") % 7 != 0)
    return sessions.retry_to_error(e, ["user_id"], ["ts", "event_id"]).select(
        "event_id", "retry_count", "to_error"
    )


_STATE_OF = {"signup": "IDLE", "view": "REVIEWING", "click": "COLLECTING_ITEMS",
             "purchase": "COMPLETED", "error": "ERROR"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in _STATE_OF.items()) + " END"


def _conversation_events(spark, sf_dir):
    state = F.lit(None).cast("string")
    for kind, name in _STATE_OF.items():
        state = F.coalesce(state, F.when(F.col("event_type") == kind, name))
    return I.events(spark, sf_dir).select("user_id", "ts", "event_id", state.alias("state"))


@query(
    "transition_log",
    f"""WITH c AS (SELECT *, {_STATE_SQL} AS state FROM events)
    SELECT event_id, lag(state) OVER w AS old_state, state AS new_state,
      (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0::DOUBLE AS duration_s,
      state IS DISTINCT FROM lag(state) OVER w AS changed
    FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def transition_log(spark, sf_dir):
    return sessions.transition_log(
        _conversation_events(spark, sf_dir), ["user_id"], ["ts", "event_id"]
    ).select("event_id", "old_state", F.col("state").alias("new_state"), "duration_s", "changed")


@query(
    "conversation_stats",
    f"""WITH c AS (SELECT user_id, arg_max({_STATE_SQL}, event_id) AS state, max(ts) AS last_activity
      FROM events GROUP BY user_id)
    SELECT state, count(*) AS n_conversations,
      count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-30 20:00:00') - epoch_us(last_activity) > 1800000000) AS n_expired
    FROM c GROUP BY ROLLUP (state)""",
)
def conversation_stats(spark, sf_dir):
    last = sessions.latest_per_key(
        _conversation_events(spark, sf_dir).withColumn("last_activity", F.col("ts")),
        ["user_id"], ["ts", "event_id"], ["state", "last_activity"],
    )
    return sessions.conversation_stats(last, F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"))


@query(
    "expired_conversations",
    """WITH c AS (SELECT user_id, max(ts) AS last_activity FROM events GROUP BY user_id)
    SELECT user_id, epoch_us(TIMESTAMP '2024-01-30 20:00:00') - epoch_us(last_activity) > 1800000000 AS expired FROM c""",
)
def expired_conversations(spark, sf_dir):
    last = I.events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last_activity"))
    at = F.lit("2024-01-30 20:00:00").cast("timestamp_ntz")
    return last.select("user_id", sessions.is_expired(F.col("last_activity"), at).alias("expired"))


def _versions(spark, sf_dir):
    return I.events(spark, sf_dir).select(
        (F.col("user_id") % 40).alias("session_id"), F.col("event_id").alias("version"),
        F.col("event_type").isin("click", "view", "purchase").alias("readable"), "ts", "event_type",
    )


@query(
    "latest_version",
    """WITH v AS (SELECT user_id % 40 AS session_id, event_id AS version,
      event_type IN ('click', 'view', 'purchase') AS readable FROM events),
    b AS (SELECT * FROM v WHERE version % 10 = 0
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY version DESC) <= 3),
    c AS (SELECT session_id, max(version) AS top, arg_max(readable, version) AS good FROM v GROUP BY session_id)
    SELECT session_id, CASE WHEN good THEN top ELSE (SELECT max(version) FROM b
      WHERE b.session_id = c.session_id AND b.readable) END AS version, NOT good AS from_backup FROM c""",
)
def latest_version(spark, sf_dir):
    return sessions.latest_version(_versions(spark, sf_dir))


@query(
    "active_sessions",
    """WITH v AS (SELECT user_id % 40 AS session_id, event_id AS version,
      event_type IN ('click', 'view', 'purchase') AS readable FROM events),
    b AS (SELECT * FROM v WHERE version % 10 = 0
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY version DESC) <= 3),
    c AS (SELECT session_id, max(version) AS top, arg_max(readable, version) AS good FROM v GROUP BY session_id)
    SELECT session_id FROM c WHERE good OR EXISTS (SELECT 1 FROM b WHERE b.session_id = c.session_id AND b.readable)""",
)
def active_sessions(spark, sf_dir):
    return sessions.active_sessions(_versions(spark, sf_dir)).select("session_id")


@query(
    "load_state_layered",
    f"""WITH {I.EVENTS}, s AS (SELECT user_id || '-' || k AS session_id,
      {I.sql_pick(["redis", "file", "memory", "gone"], "event_id")} AS layer, max(event_id) AS body FROM ev GROUP BY ALL)
    SELECT session_id, layer, body FROM s WHERE layer <> 'gone' QUALIFY row_number() OVER (PARTITION BY session_id
      ORDER BY CASE layer WHEN 'memory' THEN 1 WHEN 'file' THEN 2 ELSE 3 END) = 1""",
)
def load_state_layered(spark, sf_dir):
    layer = I.pick(["redis", "file", "memory", "gone"], F.col("event_id")).alias("layer")
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("session_id")
    states = I.events(spark, sf_dir).groupBy(session, layer).agg(F.max("event_id").alias("body"))
    return sessions.load_state_layered(states, "session_id", ["memory", "file", "redis"], ["body"])


@query(
    "evict_lru",
    """WITH u AS (SELECT user_id, max(ts) AS a FROM events GROUP BY user_id ORDER BY a DESC, user_id LIMIT 50)
    SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM u) GROUP BY user_id""",
)
def evict_lru(spark, sf_dir):
    kept = sessions.evict_lru(I.events(spark, sf_dir), "user_id", "ts", 50)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ttl_expire",
    f"""WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
    SELECT user_id FROM l WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR""",
)
def ttl_expire(spark, sf_dir):
    last = I.events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("ts"))
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return dlq.ttl_expire(last, "ts", at).select("user_id")


@query(
    "state_cleanup",
    f"""WITH l AS (SELECT user_id, max(ts) AS updated_at FROM events GROUP BY user_id)
    SELECT user_id FROM l WHERE updated_at >= TIMESTAMP '2024-02-29 06:00:00' - INTERVAL 30 DAY""",
)
def state_cleanup(spark, sf_dir):
    last = I.events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return dlq.state_cleanup(last, F.lit("2024-02-29 06:00:00").cast("timestamp_ntz")).select("user_id")


# ---- tasks ----------------------------------------------------------------------------------------------------------


@query(
    "stuck_tasks",
    f"""WITH {I.TASKS} SELECT task_id, timeout_s, round(elapsed_s, 4) AS elapsed_s,
      status = 'RUNNING' AND elapsed_s > timeout_s AS is_stuck,
      status = 'RUNNING' AND elapsed_s > timeout_s * 1.5 AS needs_recovery,
      status = 'RUNNING' AND elapsed_s > timeout_s * 2 AS is_overrun FROM task""",
)
def stuck_tasks(spark, sf_dir):
    return tasks.with_elapsed(I.tasks(spark, sf_dir), F.col("seen_at")).select(
        "task_id", "timeout_s", F.round("elapsed_s", 4).alias("elapsed_s"), "is_stuck",
        "needs_recovery", "is_overrun",
    )


_FINAL = """CASE WHEN status = 'FAILED' AND elapsed_s > timeout_s * 1.5 THEN 'RECOVERED'
  WHEN status = 'FAILED' AND elapsed_s > timeout_s THEN 'TIMEOUT' ELSE status END"""


@query(
    "task_health",
    f"""WITH {I.TASKS}, f AS (SELECT *, {_FINAL} AS fs FROM task)
    SELECT count(*) FILTER (WHERE fs = 'RUNNING') AS active, count(*) FILTER (WHERE fs = 'COMPLETED') AS completed,
      count(*) FILTER (WHERE fs = 'FAILED') AS failed, count(*) FILTER (WHERE fs = 'TIMEOUT') AS timeout,
      count(*) FILTER (WHERE fs = 'RECOVERED') AS recovered,
      count(*) FILTER (WHERE fs = 'RUNNING') <= 5
        AND count(*) FILTER (WHERE status = 'RUNNING' AND elapsed_s > timeout_s * 2) = 0 AS healthy FROM f""",
)
def task_health(spark, sf_dir):
    t = tasks.with_elapsed(I.tasks(spark, sf_dir), F.col("seen_at"))
    return tasks.task_health(tasks.terminal_status(t))


@query(
    "task_final_status",
    f"""WITH {I.TASKS} SELECT task_type, {_FINAL} AS final_status, count(*) AS n FROM task GROUP BY ALL""",
)
def task_final_status(spark, sf_dir):
    t = tasks.terminal_status(tasks.with_elapsed(I.tasks(spark, sf_dir), F.col("seen_at")))
    return t.groupBy("task_type", "final_status").agg(F.count(F.lit(1)).alias("n"))


# ---- model calls --------------------------------------------------------------------------------------------------------

_TIER_RANK = "list_position(['PRIMARY', 'SECONDARY', 'TERTIARY', 'LOCAL'], tier)"


def _pick_sql(where: str) -> str:
    return f"""WITH {I.CALLS}, r AS (SELECT *, {_TIER_RANK} * 1000 + priority AS o FROM calls WHERE {where})
    SELECT call_id, coalesce(arg_min(model, (o, model)) FILTER (WHERE ok), 'static_fallback') AS model_used,
      coalesce(arg_min(tier, (o, model)) FILTER (WHERE ok), 'STATIC') AS tier, bool_or(ok) AS success,
      CASE WHEN NOT bool_or(ok) THEN arg_max(error, (o, model)) FILTER (WHERE NOT ok) END AS error
    FROM r GROUP BY call_id"""


@query("fallback_pick", _pick_sql("true"))
def fallback_pick(spark, sf_dir):
    from billspark.operators.attempts import fallback_pick as pick_model

    return pick_model(I.model_calls(spark, sf_dir), "call_id")


@query(
    "fallback_stats",
    f"""WITH {I.CALLS} SELECT count(*) AS total_calls,
      count(*) FILTER (WHERE ok AND tier = 'PRIMARY') AS primary_success,
      count(*) FILTER (WHERE ok AND tier = 'SECONDARY') AS secondary_success,
      count(*) FILTER (WHERE ok AND tier = 'TERTIARY') AS tertiary_success,
      count(*) FILTER (WHERE ok AND tier = 'LOCAL') AS local_success,
      count(*) FILTER (WHERE NOT ok) AS total_failures,
      (sum(cost_m) FILTER (WHERE ok))::DOUBLE / 1000 AS total_cost,
      CAST(sum(tokens) FILTER (WHERE ok) AS BIGINT) AS total_tokens,
      round(avg(latency_ms) FILTER (WHERE ok), 6) AS avg_latency_ms,
      arg_max(model, event_id) FILTER (WHERE ok) AS last_used_model FROM calls""",
)
def fallback_stats(spark, sf_dir):
    calls = I.model_calls(spark, sf_dir).withColumn("call_id", F.col("event_id"))
    return usage.fallback_stats(calls).drop("static_fallback").withColumns(
        {"total_cost": I.money("total_cost"), "avg_latency_ms": F.round("avg_latency_ms", 6)}
    )


@query(
    "cost_usage",
    f"""WITH {I.CALLS} SELECT provider, model, count(*) AS n_calls, CAST(sum(tokens) AS BIGINT) AS tokens,
      sum(cost_m)::DOUBLE / 1000 AS cost FROM calls GROUP BY ROLLUP (provider, model)""",
)
def cost_usage(spark, sf_dir):
    return usage.cost_usage(I.model_calls(spark, sf_dir)).withColumn("cost", I.money("cost"))


@query(
    "running_latency",
    f"""WITH {I.CALLS} SELECT event_id, CAST(floor(1000 * avg(latency_ms) OVER (PARTITION BY tier ORDER BY ts, event_id
      ROWS UNBOUNDED PRECEDING) + 0.00001) AS BIGINT) AS running_latency_us FROM calls WHERE ok""",
)
def running_latency(spark, sf_dir):
    return usage.running_latency(
        I.model_calls(spark, sf_dir), "tier", ["ts", "event_id"]
    ).select(
        "event_id",
        F.floor(F.col("running_latency_ms") * 1000 + 0.00001).alias("running_latency_us"),
    )


@query(
    "enabled_models",
    f"""WITH {I.CALLS}, m AS (SELECT model, tier, min(priority) AS priority, bool_or(ok) AS enabled
      FROM calls GROUP BY model, tier)
    SELECT model, tier, priority, {_TIER_RANK} AS tier_rank FROM m WHERE enabled""",
)
def enabled_models(spark, sf_dir):
    models = I.model_calls(spark, sf_dir).groupBy("model", "tier").agg(
        F.min("priority").cast("bigint").alias("priority"), F.bool_or("ok").alias("enabled")
    )
    return lookups.enabled_models(models).select("model", "tier", "priority", F.col("tier_rank").cast("bigint").alias("tier_rank"))
