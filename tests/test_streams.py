"""Streams over several triggers with rows out of order, against plain Python over the ordered rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from billspark.catalog import streams
from billspark.operators import breaker as B
from billspark.session import local_path
from billspark.streaming import jobs, late, stateful

START = dt.datetime(2024, 1, 1)
MINUTE = dt.timedelta(minutes=1)


def stream_of(spark, tmp_path, schema, *arrivals):
    """One file and so one trigger for each arrival."""
    src = str(tmp_path / f"src{random.random()}")
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)


def run(stream, tmp_path):
    """All rows, and how many rows the state holds at the end."""
    name = f"t{random.randrange(10**9)}"
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect(), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def disordered(rows, seed, parts=3, minutes=8):
    """Rows by arrival: each comes up to ``minutes`` after its time."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[1] + MINUTE * minutes * rng.random())
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("machine", [B.Breaker(3, 300.0, 2, 1), B.LeakyBreaker(3, 240.0, 2)], ids=["usual", "leaky"])
def test_breaker_stream_equals_the_batch_timeline(spark, tmp_path, machine):
    rng = random.Random(9)
    orders = [None] * 18 + ["force_open", "force_close"]
    rows = [(f"s{rng.randrange(3)}", START + MINUTE * 0.5 * i, i, rng.random() > 0.5, rng.choice(orders)) for i in range(300)]
    end = START + MINUTE * 400
    rows += [("z", end, 1000, True, None)]
    schema = "service string, ts timestamp, event_id bigint, ok boolean, action string"
    got, _ = run(stateful.breaker_stream(stream_of(spark, tmp_path, schema, *disordered(rows, 1)), machine), tmp_path)
    want = B.breaker_timeline(spark.createDataFrame(rows, schema), machine).filter(F.col("ts") <= end - MINUTE * 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 300
    assert {r.state_after for r in got} >= {"OPEN", "CLOSED"}


def test_breaker_stream_forgets_silent_services(spark, tmp_path):
    rows = [("a", START + MINUTE * i, i, False, None) for i in range(3)] + [("b", START, 7, True, None), ("a", START + MINUTE * 300, 8, True, None)]
    last = [("end", START + MINUTE * 900, 9, True, None)]
    stream = stream_of(spark, tmp_path, "service string, ts timestamp, event_id bigint, ok boolean, action string", rows, last)
    got, left = run(stateful.breaker_stream(stream, B.Breaker(3, 1e6, 2, 1), forget_s=3600), tmp_path)
    assert [r.state_after for r in sorted(got, key=lambda r: r.event_id) if r.service == "a"] == ["CLOSED", "CLOSED", "OPEN", "CLOSED"]
    assert left == 1  # the row that still waits before the watermark


def chat(spark, tmp_path, *arrivals, **kw):
    schema = "user_id bigint, ts timestamp, event_id bigint, event string"
    ids = iter(range(1000))
    full = [[(u, START + MINUTE * m, next(ids), e) for u, m, e in rows] for rows in arrivals]
    got, left = run(stateful.conversation_state(stream_of(spark, tmp_path, schema, *full), **kw), tmp_path)
    return [(r.user_id, r.ts, r.event, r.old_state, r.new_state) for r in sorted(got, key=lambda r: (r.user_id, r.ts))], left


def test_conversation_ends_in_error_after_three_failures(spark, tmp_path):
    got, left = chat(
        spark, tmp_path,
        [(1, 0, "new"), (1, 2, "failure"), (2, 0, "upload"), (2, 3, "failure"), (2, 5, "failure")],
        [(1, 1, "failure"), (2, 4, "document"), (2, 9, "fatal"), (3, 3, "failure"), (1, 10, "failure")],  # disorder
        [(1, 12, "failure"), (1, 13, "new"), (9, 300, "cancel")],
    )
    short = [(u, (t - START).seconds // 60, e, a, b) for u, t, e, a, b in got]
    assert short == [
        (1, 0, "new", "IDLE", "COLLECTING_CUSTOMER"), (1, 10, "failure", "COLLECTING_CUSTOMER", "ERROR"), (1, 13, "new", "ERROR", "COLLECTING_CUSTOMER"),
        (1, 43, "timeout", "COLLECTING_CUSTOMER", "IDLE"), (2, 0, "upload", "IDLE", "AWAITING_DOCUMENT"),
        (2, 4, "document", "AWAITING_DOCUMENT", "CONFIRMING_EXTRACTED_DATA"), (2, 9, "fatal", "CONFIRMING_EXTRACTED_DATA", "ERROR"),
        (2, 39, "timeout", "ERROR", "IDLE"),
    ]
    assert left == 1


def test_a_completed_conversation_is_known_in_later_triggers(spark, tmp_path):
    done = [(1, m, e) for m, e in enumerate(["new", "text", "finish_items", "text", "format"])]
    later, end = [(1, 300, "text"), (1, 301, "new"), (2, 400, "text")], [(1, 500, "cancel"), (2, 900, "text")]
    at_once, _ = chat(spark, tmp_path, done + later + end)
    got, _ = chat(spark, tmp_path, done, [(2, 200, "text")], later, end)
    assert got == at_once and ("COMPLETED", "COLLECTING_CUSTOMER") in [r[3:] for r in got]


def marks(spark, tmp_path, *arrivals):
    schema = "task_id bigint, task_type string, ts timestamp, mark string, timeout_s double"
    full = [[(i, "t", START + dt.timedelta(seconds=s), mark, 100.0) for i, s, mark in rows] for rows in arrivals]
    got, left = run(stateful.stuck_task_watch(stream_of(spark, tmp_path, schema, *full)), tmp_path)
    return sorted((r.task_id, (r.recovered_at - START).seconds) for r in got), left


def test_stuck_tasks_leave_nothing(spark, tmp_path):
    got, left = marks(
        spark, tmp_path,
        [(1, 0, "start"), (2, 0, "start"), (3, 5, "end"), (4, 0, "start"), (4, 60, "start"), (5, 300, "end"), (6, 50, "start"), (7, 10, "start")],
        [(1, 100, "end"), (3, 6, "start"), (5, 290, "start"), (6, 201, "end"), (7, 10, "end"), (7, 20, "start"), (8, 400, "end")],
        [(99, 90_000, "start")],
    )
    # 2: no end; 4: counted from its first start; 6: end too late; 7: second run has no end; 3: its end came before its start
    assert got == [(2, 150), (4, 150), (6, 200), (7, 170)]
    assert left == 1


def test_many_keys_share_the_state_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("billspark.streaming.ordered.BUCKETS", 3)
    rows = [(i, START + MINUTE * (i % 5), str(i % 4), 3) for i in range(60)] + [(None, START, "0", 3), (2**53 + 1, START, "9", 3)]
    last = [(99, START + MINUTE * 60, "0", 3)]
    stream = stream_of(spark, tmp_path, "id bigint, ts timestamp, payload string, max_retries int", rows, last)
    got, left = run(stateful.dlq_stream(stream, lambda payload, n: n >= int(payload)), tmp_path)
    want = [(i, n, "success" if n >= int(p) else "scheduled_retry" if n < 2 else "failed") for i, _, p, _ in rows for n in range(min(int(p), 2) + 1)]
    assert sorted(((r.id, r.attempt, r.action) for r in got), key=str) == sorted(want, key=str)
    assert left == 1  # the row that still waits before the watermark
    tasks = [(i, "t", START, "start", 1e6) for i in range(60)] + [(99, "t", START + MINUTE * 60, "start", 1e6)]
    stream = stream_of(spark, tmp_path, "task_id bigint, task_type string, ts timestamp, mark string, timeout_s double", tasks)
    assert run(stateful.stuck_task_watch(stream), tmp_path)[1] <= 3  # 61 tasks that run


def test_gate_counts_and_keeps_late_rows(spark, tmp_path):
    schema = "event_id bigint, ts timestamp"
    arrivals = [[(1, START), (2, START + MINUTE * 60)], [(3, START + MINUTE * 51), (4, START + MINUTE * 50), (5, None)], [(6, START), (7, START + MINUTE * 200)], [(8, START + MINUTE * 189), (9, START + MINUTE * 191)]]
    stream = stream_of(spark, tmp_path, schema, *arrivals)
    out = str(tmp_path / "gate")
    late.admit(stream, out, str(tmp_path / "progress")).awaitTermination()
    assert {(r.event_id, r.batch) for r in late.late_rows(spark, out, stream.schema).collect()} == {(4, 1), (6, 2), (8, 3)}
    ledger = late.late_ledger(spark, out, stream.schema).orderBy("batch").collect()
    assert [(r.batch, r.start, r.n_late) for r in ledger] == [(1, START, 1), (2, START, 1), (3, START + MINUTE * 180, 1)]
    kept = jobs.run_available(late.accepted_rows(spark, out, stream.schema), "kept")
    assert {r.event_id for r in kept.collect()} == {1, 2, 3, 5, 7, 9} and kept.columns == ["event_id", "ts"]


def test_state_sync_merges_and_tidies_up(spark, tmp_path):
    schema = "session_id string, version int, body string"
    arrivals = [[(f"s{i % 4}", i, f"b{i}")] for i in range(11)]
    stream, out = stream_of(spark, tmp_path, schema, *arrivals), str(tmp_path / "state")
    jobs.state_sync(stream, out, str(tmp_path / "p"), ["session_id"], ["version"], once=True, compact_every=4).awaitTermination()
    assert jobs.finished_batches(spark, f"{out}/base") == [7] and jobs.finished_batches(spark, f"{out}/changes") == [8, 9, 10]
    want = {("s0", 8, "b8"), ("s1", 9, "b9"), ("s2", 10, "b10"), ("s3", 7, "b7")}
    assert {tuple(r) for r in jobs.current_state(spark, out, ["session_id"], ["version"]).collect()} == want
    jobs._compact(spark, out, ["session_id"], ["version"], 7)  # a replay changes nothing
    assert {tuple(r) for r in jobs.current_state(spark, out, ["session_id"], ["version"]).collect()} == want


def test_landing_stream_sets_its_rules_up_once(spark, tmp_path, monkeypatch):
    folder, out, calls = tmp_path / "landing", str(tmp_path / "out"), []
    folder.mkdir()
    for name, text in (("a.txt", "Invoice Number: INV-12345\nTotal Due: £7.00"), ("b.pdf", "%PDF-1.4"), ("c.xyz", "odd")):
        (folder / name).write_text(text)
    rules, files = jobs.validated_invoices, jobs.landing_files
    monkeypatch.setattr(jobs, "landing_files", lambda spark, folder: files(spark, folder, 1))
    monkeypatch.setattr(jobs, "validated_invoices", lambda *a: calls.append(1) or rules(*a))
    jobs.landing_stream(spark, str(folder), out, str(tmp_path / "progress"), "2024-06-30").awaitTermination()
    got = {kind: spark.read.parquet(f"{out}/{kind}") for kind in ("invoices", "rejects", "pending")}
    assert {kind: [r.path.rsplit("/", 1)[1] for r in rows.collect()] for kind, rows in got.items()} == {
        "invoices": ["a.txt"], "rejects": ["c.xyz"], "pending": ["b.pdf"]}
    assert got["invoices"].first().invoice_number == "12345" and got["invoices"].first().doc_id is not None
    assert set(got["rejects"].columns) == {"path", "length", "reject_reason", "batch"}
    assert set(got["pending"].columns) == {"path", "length", "file_type", "pending_reason", "batch"}
    assert got["invoices"].select("batch").union(got["rejects"].select("batch")).union(got["pending"].select("batch")).distinct().count() == 3
    assert len(calls) == 1


def test_small_files_share_the_tasks_of_a_trigger(spark, tmp_path):
    folder, out = tmp_path / "landing", str(tmp_path / "out")
    for i in range(320):
        (folder / f"k={i}").mkdir(parents=True)
        (folder / f"k={i}" / "a.txt").write_text(f"Invoice Number: INV-{i}")
    query = jobs.landing_stream(spark, str(folder), out, str(tmp_path / "progress"), "2024-06-30")
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) >= 4 and max(tracker.getStageInfo(s).numTasks for s in stages) <= spark.sparkContext.defaultParallelism
    found = spark.read.parquet(f"{out}/invoices")
    assert {r.invoice_number for r in found.collect()} == {str(i) for i in range(320)} and found.count() == 320
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "64k"  # the caller's session is as it was


def test_supplier_files_are_one_plain_file_each(spark, tmp_path):
    rows = [(i, 5.0 * i) for i in range(40)] + [(7, 35.0), (41, None), (None, 2.0), (None, 3.0), (-5, -8.0)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    folder = local_path(spark, streams._supplier_files(spark, str(tmp_path)))
    got = {}
    for at, _, names in os.walk(folder):
        for name in names if at != folder else []:
            got.setdefault(os.path.basename(at), []).append((name.endswith(".txt"), open(f"{at}/{name}", encoding="utf-8").read()))
    text = "Invoice Number: INV-{}\nTotal Due: £{:.2f}\n".format
    want = {f"s_suppkey={i}": text(i + 10_000, 5 * i + 1) if i % 10 else "nothing here\n" for i in range(40)}
    want |= {"s_suppkey=7": text(10_007, 36) * 2, "s_suppkey=41": "Invoice Number: INV-10041\nTotal Due: £nu\n", "s_suppkey=-5": text(9995, 9)}
    want["s_suppkey=__HIVE_DEFAULT_PARTITION__"] = "\n\n"
    assert got == {k: [(True, v)] for k, v in want.items()}
