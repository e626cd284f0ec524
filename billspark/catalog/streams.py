"""Streams over the events table: the file source reads it, the file sink keeps the result.

A window or timer counts once the watermark (latest time less ten minutes) has passed it, which the
SQL says too.
"""

from __future__ import annotations

import itertools
import os
import uuid

from pyspark.sql import functions as F

from billspark.catalog import inputs as I, resilience as RS
from billspark.catalog.registry import query
from billspark.catalog.sql_text import lit
from billspark.functions import fixed_values as V
from billspark.operators import dlq
from billspark.session import local_path, shared_folder
from billspark.sources import documents
from billspark.sources.tables import table
from billspark.streaming import jobs, late, stateful, windows

WM = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
WM_MS = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
EVENTS_DDL = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return df.withColumns({"ts": F.col("ts").cast("timestamp"), "k": k, "ok": F.col("event_type") != "error"})


#: Files of an arrival; a trigger takes as many, so that an arrival is a trigger.
_FILES = 4
#: Minutes by which a row comes after its time: less than the watermark's ten, or three days for some rows.
_DISORDER, _LATE = "event_id % 8", "CASE WHEN event_id % 13 = 0 THEN 4320 ELSE event_id % 8 END"


def _arrival(minutes: str) -> str:
    """The arrival (0 to 2) of a row, for Spark and DuckDB alike."""
    at = f"(ts + ({minutes}) * INTERVAL '1' MINUTE)"
    return f"CASE WHEN {at} < TIMESTAMP '2024-01-11 00:00:00' THEN 0 WHEN {at} < TIMESTAMP '2024-01-21 00:00:00' THEN 1 ELSE 2 END"


def _arriving(rows, name, arrival):
    """The folder to which the rows of each arrival are written, one arrival after the other."""
    folder = f"{shared_folder(rows.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for n in range(3):
        rows.filter(F.expr(arrival) == n).repartition(_FILES).write.mode("append").parquet(folder)
    return folder


def _in_three(spark, sf_dir, minutes, name):
    """The events as a stream of three triggers with rows out of order."""
    rows = I.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _arriving(rows, name, _arrival(minutes))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _FILES).parquet(folder)


_SESSIONS = f"""WITH g AS (SELECT user_id % 5 AS user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts)
    < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
  SELECT user_id, {I.sql_stamp("min(ts)")} AS started_at, {I.sql_stamp("max(ts) + INTERVAL 30 MINUTE")} AS ends_at, count(*) AS n_events
  FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= {WM}"""


@query("conversation_sessions", _SESSIONS)
def conversation_sessions(spark, sf_dir):
    few = _stream(spark, sf_dir).withColumn("user_id", F.col("user_id") % 5)
    out = jobs.run_available(windows.conversation_sessions(few), "sessions")
    return out.select("user_id", I.stamp("started_at").alias("started_at"), I.stamp("ends_at").alias("ends_at"), "n_events")


def _kpi_stream(spark, sf_dir):
    return _stream(spark, sf_dir).select(
        "ts", (~F.col("ok")).alias("is_error"), (F.col("value") / 10).alias("response_s")
    )


@query(
    "windowed_kpis_tumbling",
    f"""SELECT {I.sql_stamp("date_trunc('hour', ts)")} AS start, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
    round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate
    FROM events GROUP BY date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {WM}""",
)
def windowed_kpis_tumbling(spark, sf_dir):
    out = jobs.run_available(windows.windowed_kpis(_kpi_stream(spark, sf_dir)), "kpis")
    return out.select(I.stamp("start").alias("start"), "n_events", "n_errors", F.round("error_rate", 6).alias("error_rate"))


@query(
    "windowed_kpis_sliding",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * i AS st, event_type FROM events, range(0, 12) t(i))
    SELECT {I.sql_stamp("st")} AS start, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
    round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate
    FROM w GROUP BY st HAVING st + INTERVAL 1 HOUR <= {WM}""",
)
def windowed_kpis_sliding(spark, sf_dir):
    sliding = windows.windowed_kpis(_kpi_stream(spark, sf_dir), "1 hour", "5 minutes")
    out = jobs.run_available(sliding, "kpis")
    return out.select(I.stamp("start").alias("start"), "n_events", "n_errors", F.round("error_rate", 6).alias("error_rate"))


@query("dedupe_updates", "SELECT event_id AS update_id, user_id FROM events")
def dedupe_updates(spark, sf_dir):
    """Every update is delivered twice."""
    once = _stream(spark, sf_dir).select(F.col("event_id").alias("update_id"), "user_id", "ts")
    return jobs.run_available(windows.dedupe_updates(once.union(once)), "updates").select("update_id", "user_id")


_RELEASED = RS._TIMELINE.replace("FROM walk WHERE n > 0", f"FROM walk WHERE n > 0 AND event_id IN (SELECT event_id FROM events WHERE ts <= {WM_MS})")


@query("breaker_stream", RS._breaker_sql("CAST(user_id AS VARCHAR)", 2, 43_200_000_000, 2, 2, _RELEASED))
def breaker_stream(spark, sf_dir):
    """Three triggers with rows out of order give the batch timeline."""
    calls = _in_three(spark, sf_dir, _DISORDER, "calls").select(F.col("user_id").cast("string").alias("service"), "ts", "event_id", "ok")
    return jobs.run_available(stateful.breaker_stream(calls, RS._PER_USER), "breaker").select(*RS._SHOWN)


_EVENT_SQL = """CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'text' WHEN 'click' THEN 'finish_items' WHEN 'purchase' THEN 'format'
  WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 'cancel' ELSE 'failure' END END"""
_RULE_SQL = """CASE WHEN event = 'new' THEN 'COLLECTING_CUSTOMER' WHEN event = 'cancel' THEN 'IDLE'
  WHEN st = 'COLLECTING_CUSTOMER' AND event = 'text' THEN 'COLLECTING_ITEMS'
  WHEN st = 'COLLECTING_ITEMS' AND event = 'finish_items' THEN 'COLLECTING_NOTES'
  WHEN st = 'COLLECTING_NOTES' AND event = 'text' THEN 'REVIEWING'
  WHEN st = 'REVIEWING' AND event = 'format' THEN 'COMPLETED' END"""
_ENDED = "('IDLE', 'COMPLETED')"
_IDLE_US = 12 * 3600 * 1_000_000


@query(
    "conversation_state",
    f"""WITH RECURSIVE {I.EVENTS}, seq AS (SELECT user_id AS u, epoch_us(ts) AS t, {_EVENT_SQL} AS event,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev WHERE ts <= {WM_MS}),
    walk AS (SELECT u, 0::BIGINT AS n, 0::BIGINT AS t, 0::BIGINT AS f, 'IDLE' AS old, 'IDLE' AS nw, NULL::VARCHAR AS lapsed, 0::BIGINT AS lapsed_at, ''::VARCHAR AS event
        FROM (SELECT DISTINCT u FROM seq)
      UNION ALL
      SELECT u, n, t, f1, st, coalesce(rule, CASE WHEN fail AND f1 >= 3 THEN 'ERROR' ELSE st END), lapsed, lapsed_at, event FROM (
        SELECT *, CASE WHEN rule IS NOT NULL THEN 0 WHEN fail THEN f0 + 1 ELSE f0 END AS f1 FROM (
          SELECT *, {_RULE_SQL} AS rule, event = 'failure' AND st NOT IN {_ENDED} AS fail FROM (
            SELECT s.u, s.n, s.t, s.event, over, w.t + {_IDLE_US} AS lapsed_at, CASE WHEN over THEN 'IDLE' ELSE w.nw END AS st,
              CASE WHEN over THEN 0 ELSE w.f END AS f0, CASE WHEN over THEN w.nw END AS lapsed
            FROM (SELECT w.*, s.n AS sn, w.nw NOT IN {_ENDED} AND s.t - w.t > {_IDLE_US} AS over FROM walk w JOIN seq s ON s.u = w.u AND s.n = w.n + 1) w
            JOIN seq s ON s.u = w.u AND s.n = w.sn))))
    SELECT u AS user_id, {I.sql_stamp("make_timestamp(t)")} AS at, event, old AS old_state, nw AS new_state FROM walk WHERE n > 0 AND old <> nw
    UNION ALL
    SELECT u, {I.sql_stamp("make_timestamp(lapsed_at)")}, 'timeout', lapsed, 'IDLE' FROM walk WHERE n > 0 AND lapsed IS NOT NULL
    UNION ALL
    SELECT u, {I.sql_stamp(f"make_timestamp(t + {_IDLE_US})")}, 'timeout', nw, 'IDLE' FROM (SELECT * FROM walk QUALIFY n = max(n) OVER (PARTITION BY u))
    WHERE nw NOT IN {_ENDED} AND t + {_IDLE_US} <= epoch_us({WM_MS})""",
)
def conversation_state(spark, sf_dir):
    """Every transition of every user, over three triggers with rows out of order."""
    chat = _in_three(spark, sf_dir, _DISORDER, "chat").select("user_id", "ts", "event_id", F.expr(_EVENT_SQL).alias("event"))
    out = jobs.run_available(stateful.conversation_state(chat, idle_ms=_IDLE_US // 1000), "conversations")
    return out.select("user_id", I.stamp("ts").alias("at"), "event", "old_state", "new_state")


_MARKS = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM (SELECT ts FROM ev UNION ALL SELECT ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) FROM ev WHERE event_type IN ('purchase', 'signup', 'error')))"


@query(
    "stuck_task_watch",
    f"""WITH {I.TASKS} SELECT task_id, task_type FROM task JOIN ev ON event_id = task_id
    WHERE epoch_us(ts) + CAST(timeout_s * 1500 AS BIGINT) * 1000 <= epoch_us({_MARKS})
      AND (status = 'RUNNING' OR CAST(round(value * 1000000) AS BIGINT) > CAST(timeout_s * 1500 AS BIGINT) * 1000)""",
)
def stuck_task_watch(spark, sf_dir):
    timeout = F.lit(None).cast("double")
    for name, seconds in V.TASK_TIMEOUTS:
        timeout = F.coalesce(timeout, F.when(F.col("task_type") == name, F.lit(seconds)))
    base = _stream(spark, sf_dir).withColumn("task_type", I.pick(I.TASK_TYPES, F.col("k"))).withColumn(
        "timeout_s", F.coalesce(timeout, F.lit(V.TASK_TIMEOUT_DEFAULT))
    )
    start = base.select(F.col("event_id").alias("task_id"), "task_type", "ts", F.lit("start").alias("mark"), "timeout_s")
    end = base.filter(F.col("event_type").isin("purchase", "signup", "error")).select(
        F.col("event_id").alias("task_id"), "task_type",
        I.plus_seconds(F.col("ts"), F.col("value")).alias("ts"), F.lit("end").alias("mark"), "timeout_s",
    )
    out = jobs.run_available(stateful.stuck_task_watch(start.union(end)), "stuck")
    return out.select("task_id", "task_type")


@query(
    "dlq_stream",
    f"""WITH {I.EVENTS}, s AS (SELECT event_id AS id, epoch_ms(ts) AS t0, k % 8 AS need, a AS attempt,
      epoch_ms(ts) + CAST(list_sum(list_transform(range(0, a), lambda i: least(60 * pow(2, i), 3600))) AS BIGINT) * 1000 AS due FROM ev, range(0, 5) t(a))
    SELECT id, attempt, CASE WHEN attempt >= need THEN 'success' WHEN attempt < 4 THEN 'scheduled_retry' ELSE 'failed' END AS action
    FROM (SELECT id, attempt, need, coalesce(due, t0) AS due FROM s) WHERE attempt <= need AND due <= epoch_ms({WM})""",
)
def dlq_stream(spark, sf_dir):
    """A handler that works from the (k % 8)-th try on; five tries are allowed."""
    items = _stream(spark, sf_dir).select(
        F.col("event_id").alias("id"), "ts", (F.col("k") % 8).cast("string").alias("payload"), F.lit(5).alias("max_retries")
    )
    out = jobs.run_available(stateful.dlq_stream(items, lambda payload, n: n >= int(payload)), "dlq")
    return out.select("id", F.col("attempt").cast("bigint").alias("attempt"), "action")


_ARRIVED = f"""arrived AS (SELECT *, {_arrival(_LATE)} AS batch FROM events),
  judged AS (SELECT *, coalesce(ts <= (SELECT max(b.ts) FROM arrived b WHERE b.batch < a.batch) - INTERVAL 10 MINUTE, false) AS late FROM arrived a),
  taken AS (SELECT * FROM judged WHERE NOT late)"""
_TAKEN_WM = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM taken)"


def _admitted(spark, sf_dir):
    """Events of three triggers, some of them days late, through the gate: its folder and the rows' schema."""
    rows = _in_three(spark, sf_dir, _LATE, "arrivals")
    out = f"{shared_folder(spark).rstrip('/')}/admitted-{uuid.uuid4().hex}"
    late.admit(rows, f"{out}/data", f"{out}/progress").awaitTermination()
    return f"{out}/data", rows.schema


@query(
    "late_row_ledger",
    f"""WITH {_ARRIVED} SELECT batch, {I.sql_stamp("date_trunc('hour', ts)")} AS start, count(*) AS n_late FROM judged WHERE late GROUP BY ALL""",
)
def late_row_ledger(spark, sf_dir):
    ledger = late.late_ledger(spark, *_admitted(spark, sf_dir))
    return ledger.select("batch", I.stamp("start").alias("start"), "n_late")


@query(
    "windowed_kpis_of_admitted",
    f"""WITH {_ARRIVED} SELECT {I.sql_stamp("date_trunc('hour', ts)")} AS start, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
    round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate
    FROM taken GROUP BY date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_TAKEN_WM}""",
)
def windowed_kpis_of_admitted(spark, sf_dir):
    rows = late.accepted_rows(spark, *_admitted(spark, sf_dir), _FILES)
    calls = rows.select("ts", (~F.col("ok")).alias("is_error"), (F.col("value") / 10).alias("response_s"))
    out = jobs.run_available(windows.windowed_kpis(calls), "kpis")
    return out.select(I.stamp("start").alias("start"), "n_events", "n_errors", F.round("error_rate", 6).alias("error_rate"))


@query(
    "conversation_sessions_of_admitted",
    f"""WITH {_ARRIVED}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM taken),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, {I.sql_stamp("min(ts)")} AS started_at, {I.sql_stamp("max(ts) + INTERVAL 6 HOUR")} AS ends_at, count(*) AS n_events
    FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 6 HOUR <= {_TAKEN_WM}""",
)
def conversation_sessions_of_admitted(spark, sf_dir):
    rows = late.accepted_rows(spark, *_admitted(spark, sf_dir), _FILES)
    out = jobs.run_available(windows.conversation_sessions(rows, idle="6 hours"), "sessions")
    return out.select("user_id", I.stamp("started_at").alias("started_at"), I.stamp("ends_at").alias("ends_at"), "n_events")


@query("dedupe_updates_of_admitted", f"WITH {_ARRIVED} SELECT event_id AS update_id, user_id FROM taken")
def dedupe_updates_of_admitted(spark, sf_dir):
    """Every update that the gate accepts is delivered twice."""
    rows = late.accepted_rows(spark, *_admitted(spark, sf_dir), _FILES).select(F.col("event_id").alias("update_id"), "user_id", "ts")
    return jobs.run_available(windows.dedupe_updates(rows.union(rows)), "updates").select("update_id", "user_id")


@query("state_sync", "SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS body FROM events GROUP BY user_id")
def state_sync(spark, sf_dir):
    """The last event of each user from three intervals, of which the first two have been merged."""
    rows = _in_three(spark, sf_dir, _LATE, "changes").select("user_id", F.col("event_id").alias("version"), F.col("event_type").alias("body"))
    out = f"{shared_folder(spark).rstrip('/')}/synced-{uuid.uuid4().hex}"
    jobs.state_sync(rows, f"{out}/state", f"{out}/progress", ["user_id"], ["version"], once=True, compact_every=2).awaitTermination()
    return jobs.current_state(spark, f"{out}/state", ["user_id"], ["version"])


_LOG_SQL = f"""WITH {I.EVENTS} SELECT CASE WHEN k >= 5 THEN event_type END AS event, CASE WHEN k >= 10 THEN event_id END AS user_id, k < 5 AS rejected,
  CASE WHEN k < 5 THEN '{{"event":"' || event_type || '","user_id":' || event_id
    WHEN k < 10 THEN '{{"event":"' || event_type || '","user_id":"u' || event_id || '"}}' END AS rescued FROM ev"""
_LOG_COLUMNS = ["event", "user_id", "rejected", "rescued"]


def _log_folder(spark, sf_dir):
    """Log lines of three arrivals; some are cut short, some hold a text where a number is declared."""
    head = F.concat(F.lit('{"event":"'), "event_type", F.lit('","user_id":'))
    number = F.col("event_id").cast("string")
    line = F.when(F.col("k") < 5, F.concat(head, number)).when(F.col("k") < 10, F.concat(head, F.lit('"u'), number, F.lit('"}')))
    rows = I.events(spark, sf_dir).withColumn("value", line.otherwise(F.concat(head, number, F.lit("}"))))
    folder = f"{shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    for n in range(3):
        rows.filter(F.expr(_arrival(_DISORDER)) == n).select("value").repartition(_FILES).write.mode("append").text(folder)
    return folder


@query("event_log_stream", _LOG_SQL)
def event_log_stream(spark, sf_dir):
    """Log lines over three triggers."""
    lines = documents.stream_event_log(spark, _log_folder(spark, sf_dir), files_per_trigger=_FILES)
    return jobs.run_available(lines, "log").select(*_LOG_COLUMNS)


@query("event_log_folder", _LOG_SQL)
def event_log_folder(spark, sf_dir):
    return documents.scan_event_log(spark, _log_folder(spark, sf_dir)).select(*_LOG_COLUMNS)


# ---- folders of files: a small text document for each supplier --------------------------------------------------

def _supplier_files(spark, sf_dir):
    """A folder with one text file for each supplier; every tenth says nothing of use."""
    number, total = (F.col("s_suppkey") + 10_000).cast("string"), F.format_string("%.2f", F.abs("s_acctbal") + 1)
    text = F.concat(F.lit("Invoice Number: INV-"), number, F.lit("\nTotal Due: £"), total)
    rows = table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, "nothing here").otherwise(text).alias("value")
    )
    folder = f"{shared_folder(spark).rstrip('/')}/suppliers-{uuid.uuid4().hex}"
    # a file costs far more than its bytes: many tasks write them, and each puts its own in their place
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows, local = rows.repartition(n, "s_suppkey"), local_path(spark, folder)
    if local:
        rows.sortWithinPartitions("s_suppkey").foreachPartition(_text_files(local))
    else:
        writer = rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.partitionBy("s_suppkey").text(folder)
    return folder


def _text_files(folder):
    """As Spark's ``partitionBy("s_suppkey").text``, for a folder in a local file system.

    There Hadoop starts a process (chmod) for every folder, file and checksum it makes, which takes many times as long as the
    writing. A file gets its name when it is whole, so a task that is tried again leaves the same files.
    """

    def write(rows):
        for key, lines in itertools.groupby(rows, key=lambda r: r.s_suppkey):
            at = f"{folder}/s_suppkey={'__HIVE_DEFAULT_PARTITION__' if key is None else key}"
            os.makedirs(at, exist_ok=True)
            part = f"{at}/.part-{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8", newline="") as file:
                file.writelines(f"{r.value or ''}\n" for r in lines)
            os.replace(part, f"{at}/part-00000.txt")

    return write


def _supplier_of(path):
    return F.regexp_extract(path, "s_suppkey=([0-9]+)", 1).cast("bigint").alias("s_suppkey")


@query(
    "scan_documents",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 13 ELSE length(printf('Invoice Number: INV-%d#Total Due: ##%.2f#', s_suppkey + 10000, abs(s_acctbal) + 1)) END AS length,
    'text' AS file_type, CASE WHEN s_suppkey % 10 = 0 THEN 'nothing here' ELSE 'Invoice Number: INV-' || (s_suppkey + 10000) END AS head FROM supplier""",
)
def scan_documents(spark, sf_dir):
    files = documents.scan_documents(spark, _supplier_files(spark, sf_dir), glob="*.txt")
    texts = documents.text_documents(files).select("path", F.split("text", "\n")[0].alias("head"))
    kinds = files.select(_supplier_of("path"), "length", "file_type")
    return kinds.join(texts.select(_supplier_of("path"), "head"), "s_suppkey")


@query(
    "landing_stream",
    """SELECT CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey + 10000 AS VARCHAR) END AS invoice_number,
    CASE WHEN s_suppkey % 10 <> 0 THEN round(abs(s_acctbal) + 1, 2) END AS total_due, count(*) AS n FROM supplier GROUP BY ALL""",
)
def landing_stream(spark, sf_dir):
    """Files that land in a folder, as invoices."""
    out = f"{shared_folder(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    jobs.landing_stream(spark, _supplier_files(spark, sf_dir), f"{out}/data", f"{out}/progress", "2024-06-30").awaitTermination()
    total = F.col("financials")["total_due"].cast("double")
    found = spark.read.parquet(f"{out}/data/invoices").select("invoice_number", total.alias("total_due"))
    return found.groupBy("invoice_number", "total_due").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dlq_round_trip",
    """SELECT operation_type, error_type, status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (
      SELECT o_orderkey, 'store_invoice' AS operation_type, 'ValueError' AS error_type, 'PENDING' AS status FROM orders WHERE o_totalprice > 400000
      UNION ALL SELECT o_orderkey, 'extract_fields', 'KeyError', 'PENDING' FROM orders WHERE o_totalprice < 2000) GROUP BY ALL""",
)
def dlq_round_trip(spark, sf_dir):
    """Dead letters of two operations appended to one folder and read back with their schema."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    folder = f"{shared_folder(spark).rstrip('/')}/dead-{uuid.uuid4().hex}"
    as_of = F.lit("2024-06-30 00:00:00").cast("timestamp")
    for operation, kind, bad in (("store_invoice", "ValueError", F.col("o_totalprice") > 400000), ("extract_fields", "KeyError", F.col("o_totalprice") < 2000)):
        error = F.when(bad, F.struct(F.lit(kind).alias("error_type"), F.lit("out of range").alias("error_message")))
        _, dead = dlq.quarantine_split(rows, error, operation, as_of, ["o_orderkey", "o_totalprice"])
        dlq.write_dlq(dead, folder)
    back = dlq.read_dlq(spark, folder, dead.schema)
    return back.groupBy("operation_type", "error_type", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
