"""Errors, retries, dead letters, sessions, tasks, stores and landing jobs on the listed cases."""

import datetime as dt

from pyspark.sql import functions as F

from billspark.catalog.registry import ORACLES, QUERIES
from billspark.operators import dlq, errors, lookups, retry, sessions, tasks
from billspark.session import shared_folder
from billspark.sources import documents, stores
from billspark.streaming import jobs, stateful
from tests.test_extraction import SAMPLE

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def classified(spark, messages, **kw):
    df = spark.createDataFrame([(i, "Exception", m) for i, m in enumerate(messages)], "error_id int, error_type string, message string")
    return [r for r in errors.classify_errors(df, **kw).orderBy("error_id").collect()]


def test_error_cases(spark):
    got = classified(spark, ["429 too many requests", "read timeout", "401 unauthorized", "service unavailable", "load failed"])
    assert [(r.is_retryable, r.max_retries, r.retry_delay_base, r.severity) for r in got[:4]] == [
        (True, 5, 2.0, "MEDIUM"), (True, 3, 1.0, "MEDIUM"), (False, 0, 0.0, "HIGH"), (True, 3, 0.5, "TRANSIENT")
    ]
    assert got[4].category == "ai_model"
    assert classified(spark, ["load failed"], word_boundary=True)[0].category == "unknown"


def test_retry_schedule(spark):
    ops = lookups.with_retry_policy(spark.createDataFrame([("op", "database", T0)], "operation string, policy string, ts timestamp"))
    rows = retry.retry_schedule(ops).orderBy("attempt").collect()
    assert [r.delay_s for r in rows][:3] == [0.5, 0.75, 1.125]
    assert rows[1].due_at == T0 + dt.timedelta(seconds=1.25)
    delays = spark.range(8).select(retry.dlq_delay(F.col("id"))).collect()
    assert [r[0] for r in delays] == [60, 120, 240, 480, 960, 1920, 3600, 3600]


def dlq_events(spark, actions):
    rows = [("x", "extract", at(i), i, a, "e" if a == "scheduled_retry" else None, 5, 5) for i, a in enumerate(actions)]
    return spark.createDataFrame(rows, "id string, operation_type string, ts timestamp, event_no int, action string, error string, priority int, max_retries int")


def test_dlq_fold(spark):
    r = dlq.dlq_apply_events(dlq_events(spark, ["enqueue", "processing_started", "scheduled_retry", "scheduled_retry"])).first()
    assert (r.status, r.retry_count, r.next_retry_at, r.last_error) == ("RETRYING", 2, at(3 + 120), "e")
    r = dlq.dlq_apply_events(dlq_events(spark, ["enqueue", "scheduled_retry", "manual_retry", "scheduled_retry", "failed"])).first()
    assert (r.status, r.retry_count, r.n_events) == ("FAILED", 1, 5)


def test_dlq_ends_as_failed(spark):
    df = spark.createDataFrame([(5, 5), (4, 5), (3, 5)], "retry_count int, max_retries int")
    assert [r[0] for r in df.select(dlq.next_action(F.lit(False))).collect()] == ["failed", "failed", "scheduled_retry"]
    r = dlq.dlq_apply_events(dlq_events(spark, ["enqueue"] + ["scheduled_retry"] * 5)).first()
    assert (r.status, r.retry_count, r.next_retry_at) == ("FAILED", 5, None)


def test_dlq_stream_acts_on_every_row(spark, tmp_path):
    rows = [(1, at(0), "2", 5), (1, at(5), "0", 5), (2, at(7), "9", 3), (3, at(100_000), "0", 5), (4, at(200_000), "0", 5)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, payload string, max_retries int")
    df.repartition(1).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "a"))
    got = jobs.run_available(stateful.dlq_stream(stream, lambda p, n: n >= int(p)), "dlq").collect()
    assert sorted((r.attempt, r.action) for r in got if r.id == 1) == [(0, "scheduled_retry"), (0, "success"), (1, "scheduled_retry"), (2, "success")]
    assert sorted((r.attempt, r.action) for r in got if r.id == 2) == [(0, "scheduled_retry"), (1, "scheduled_retry"), (2, "failed")]


def test_sessions(spark):
    rows = [("s", v, v != 12) for v in (8, 9, 10, 11, 12)] + [("t", 3, True), ("u", 5, False)]
    df = spark.createDataFrame(rows, "session_id string, version int, readable boolean")
    got = {r.session_id: (r.version, r.from_backup) for r in sessions.latest_version(df).collect()}
    assert got == {"s": (10, True), "t": (3, False), "u": (None, True)}
    assert {r[0] for r in sessions.active_sessions(df).select("session_id").collect()} == {"s", "t"}
    last = spark.createDataFrame([(T0,)], "ts timestamp")
    edge = [last.select(sessions.is_expired(F.col("ts"), F.lit(at(s)))).first()[0] for s in (1800, 1801)]
    assert edge == [False, True]


def test_tasks(spark):
    rows = [(str(s), "document_processing", T0, None, "RUNNING", at(s)) for s in (45, 50, 70, 91)]
    df = spark.createDataFrame(rows, "task_id string, task_type string, started_at timestamp, ended_at timestamp, status string, seen timestamp")
    got = {r.task_id: (r.is_stuck, r.needs_recovery, r.is_overrun) for r in tasks.with_elapsed(df, F.col("seen")).collect()}
    assert got == {"45": (False,) * 3, "50": (True, False, False), "70": (True, True, False), "91": (True,) * 3}
    health = tasks.task_health(tasks.terminal_status(tasks.with_elapsed(df, F.col("seen")))).first()
    assert (health.active, health.healthy) == (4, False)


def test_quarantine(spark):
    df = spark.createDataFrame([(1, 5), (2, -5)], "id int, amount int")
    error = F.when(F.col("amount") < 0, F.struct(F.lit("ValueError").alias("error_type"), F.lit("negative").alias("error_message")))
    good, bad = dlq.quarantine_split(df, error, "store", F.lit(T0), ["id", "amount"])
    assert [r.id for r in good.collect()] == [1]
    assert [(r.id, r.payload, r.status) for r in bad.collect()] == [(2, '{"id":2,"amount":-5}', "PENDING")]


def test_invoice_store(spark, tmp_path):
    folder = str(tmp_path / "inv")
    df = spark.createDataFrame([(1, "INV-1", "2024-01"), (2, "INV-2", "2024-02")], "id int, invoice_number string, month string")
    stores.write_invoices(df, folder, "month")
    back = stores.read_invoices(spark, folder, df.schema, invoice_number="INV-2")
    assert [r.id for r in back.collect()] == [2]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(invoice_number,INV-2)" in plan
    stores.overwrite_partitions(df.filter("id = 2").withColumn("invoice_number", F.lit("INV-9")), folder, "month")
    again = stores.read_invoices(spark, folder, df.schema)
    assert {(r.id, r.invoice_number) for r in again.collect()} == {(1, "INV-1"), (2, "INV-9")}


def test_scan_and_landing(spark, tmp_path):
    src = tmp_path / "landing"
    src.mkdir()
    (src / "a.txt").write_text(SAMPLE.format(n=7))
    (src / "b.txt").write_bytes("Invoice Number: INV-8\nTotal Due: £5.00\n".encode("latin-1"))
    (src / "c.bin").write_bytes(b"\x00\x01")
    (src / "d.pdf").write_bytes(b"%PDF-1.4")
    files = documents.scan_documents(spark, str(src))
    kinds = {r.path.rsplit("/", 1)[1]: r.file_type for r in files.select("path", "file_type").collect()}
    assert kinds == {"a.txt": "text", "b.txt": "text", "c.bin": "unknown", "d.pdf": "pdf"}
    out = str(tmp_path / "out")
    jobs.landing_stream(spark, str(src), out, str(tmp_path / "progress"), "2024-06-30").awaitTermination()
    found = spark.read.parquet(f"{out}/invoices").collect()
    assert {r.invoice_number for r in found} == {"2023-007", "8"}
    rejects = spark.read.parquet(f"{out}/rejects").collect()
    assert [r.reject_reason for r in rejects] == ["unsupported_format"]
    pending = spark.read.parquet(f"{out}/pending").collect()
    assert [(r.path.rsplit("/", 1)[1], r.file_type, r.pending_reason) for r in pending] == [("d.pdf", "pdf", "needs_text_extraction")]
    assert len(found) + len(rejects) + len(pending) == 4


def test_large_files_are_not_opened(spark, tmp_path):
    for name, size in (("small.txt", 10), ("large.txt", 5000), ("odd.csv", 10)):
        (tmp_path / name).write_text("x" * size)
    good, bad = documents.split_supported(documents.scan_documents(spark, [str(tmp_path)]), max_bytes=100)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan
    assert [r.path.rsplit("/", 1)[1] for r in documents.text_documents(good).collect()] == ["small.txt"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["too_large", "unsupported_format"]


def test_state_sync(spark, tmp_path):
    src = str(tmp_path / "changes")
    df = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "c")], "session_id string, version int, body string")
    out, later = str(tmp_path / "out"), spark.createDataFrame([("s", 3, "d"), ("u", 1, "e")], df.schema)
    for rows in (df, later):
        rows.write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        jobs.state_sync(stream, out, str(tmp_path / "progress"), ["session_id"], ["version"], once=True).awaitTermination()
    got = jobs.current_state(spark, out, ["session_id"], ["version"]).collect()
    assert sorted(map(tuple, got)) == [("s", 3, "d"), ("t", 1, "c"), ("u", 1, "e")]


def test_form_conversation(spark, tmp_path):
    events = ["start", "chat"] + ["answer"] * 12 + ["skip_work"] + ["answer"] * 4 + ["confirm_all"]
    rows = [(1, at(i), i, e) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp, event_id bigint, event string")
    src = str(tmp_path / "chat")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = jobs.run_available(stateful.conversation_state(stream, stateful.FORM_TRANSITIONS, watermark="0 seconds"), "form").orderBy("ts").collect()
    assert out[0].new_state == "SELECT_MODE" and out[-1].new_state == "COMPLETED"
    assert "CIS_AMOUNT" in {r.new_state for r in out}
    assert len(out) == len(events)


def test_event_log(spark):
    lines = spark.createDataFrame([('{"event": "done", "user_id": 3}',), ("{broken",)], "value string")
    got = documents.parse_event_lines(lines).collect()
    assert [(r.event, r.user_id, r.rejected) for r in got] == [("done", 3, False), (None, None, True)]


def test_shared_folder_is_there(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_registered(spark):
    import billspark.catalog  # noqa: F401

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
