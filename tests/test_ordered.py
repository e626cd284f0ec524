"""Sliced scans and breakers against plain Python, with one key holding most rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from billspark.operators import breaker as B, sessions, slices, stats

START = dt.datetime(2024, 1, 1)


def skewed(n=600, seed=1, gap=20, fail=0.4):
    """(key, ts, id, ok): two thirds of the rows belong to one key; some times are equal."""
    rng = random.Random(seed)
    t, rows = START, []
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, 5, gap]))
        key = "hot" if rng.random() < 0.66 else f"k{rng.randrange(6)}"
        rows.append((key, t, i, rng.random() > fail))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "service string, ts timestamp, event_id bigint, ok boolean")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_totals_and_numbers(spark):
    rows = skewed()
    got = slices.running_totals(
        frame(spark, rows), ["service"], ["ts", "event_id"], {"n_ok": F.col("ok").cast("int"), "n": F.lit(1)}, rows_per_slice=50
    ).collect()
    assert len(got) == len(rows)
    seen = {r.event_id: (r.n_ok, r.n) for r in got}
    for group in by_key(rows).values():
        ok = 0
        for n, r in enumerate(group, 1):
            ok += r[3]
            assert seen[r[2]] == (ok, n)


def test_runs_and_neighbours(spark):
    rows = skewed(seed=2)
    runs = {r.event_id: r for r in sessions.consecutive_runs(frame(spark, rows), "service", ["ts", "event_id"], rows_per_slice=40).collect()}
    near = {
        r.event_id: (r.before, r.after)
        for r in slices.neighbours(
            frame(spark, rows), ["service"], ["ts", "event_id"], {"before": "event_id"}, {"after": "event_id"}, rows_per_slice=40
        ).collect()
    }
    for group in by_key(rows).values():
        bad = good = 0
        ids = [r[2] for r in group]
        for i, r in enumerate(group):
            bad, good = (0, good + 1) if r[3] else (bad + 1, 0)
            assert (runs[r[2]].consecutive_failures, runs[r[2]].consecutive_successes) == (bad, good)
            assert near[r[2]] == (ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None)


def replay(machine, group):
    state, out = machine.start(), {}
    for _, ts, event_id, ok in group:
        us = int((ts - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        before = B.NAMES[state[0]]
        state, allowed, changed = machine.step(state, us, ok)
        out[event_id] = (allowed, before, B.NAMES[state[0]], changed)
    return out


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("fail", [0.3, 0.9])
@pytest.mark.parametrize(
    "machine", [B.Breaker(3, 30.0, 2, 1), B.Breaker(2, 60.0, 1, 3), B.LeakyBreaker(3, 25.0, 2)], ids=["usual", "dead_end", "leaky"]
)
def test_breaker_over_slices(spark, machine, seed, fail):
    rows = skewed(300, seed, fail=fail)
    got = B.breaker_timeline(frame(spark, rows), machine, rows_per_slice=25).collect()
    seen = {r.event_id: (r.allowed, r.state_before, r.state_after, r.state_change) for r in got}
    want = {}
    for group in by_key(rows).values():
        want |= replay(machine, group)
    assert seen == want


def test_breaker_case(spark):
    marks = [(0, False), (1, False), (2, False), (12, True), (32, True), (33, False), (34, False), (35, False), (66, False)]
    rows = [("ai", START + dt.timedelta(seconds=s), i, ok) for i, (s, ok) in enumerate(marks)]
    tl = B.breaker_timeline(frame(spark, rows), B.Breaker(3, 30.0, 2, 1)).orderBy("event_id").collect()
    assert [r.state_after for r in tl] == ["CLOSED", "CLOSED", "OPEN", "OPEN", "CLOSED", "CLOSED", "CLOSED", "OPEN", "OPEN"]
    assert [r.allowed for r in tl] == [True] * 3 + [False] + [True] * 5
    s = B.breaker_stats(B.breaker_timeline(frame(spark, rows), B.Breaker(3, 30.0, 2, 1))).first()
    assert (s.failures, s.successes, s.rejected, s.state_changes, s.state) == (7, 1, 1, 4, "OPEN")


def test_manual_orders(spark):
    rows = [("a", START, 0, True, "force_open"), ("a", START + dt.timedelta(seconds=1), 1, True, None),
            ("a", START + dt.timedelta(seconds=2), 2, True, "force_close"), ("a", START + dt.timedelta(seconds=3), 3, True, None)]
    df = spark.createDataFrame(rows, "service string, ts timestamp, event_id bigint, ok boolean, action string")
    tl = B.breaker_timeline(df, B.Breaker(3, 30.0)).orderBy("event_id").collect()
    assert [(r.state_after, r.allowed) for r in tl] == [("OPEN", True), ("OPEN", False), ("CLOSED", True), ("CLOSED", True)]


def test_response_quantiles_are_exact(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), rng.choice([rng.random(), 0.5, 0.25])) for _ in range(30_000)]
    rows += [("one", 3.0), ("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "kind string, response_s double")
    got = {r.kind: r.q for r in stats.response_quantiles(df, ["kind"], rows_per_slice=1000).collect()}
    for kind in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == kind and v is not None)
        want = [values[max(1, math.ceil(len(values) * p)) - 1] for p in (0.5, 0.95, 0.99)] if values else None
        assert got[kind] == want


def test_runs_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(slices, "materialize", lambda df, name: (written.append(name), df)[1])
    sessions.consecutive_runs(frame(spark, skewed(50)), "service", ["ts", "event_id"]).count()
    assert written == ["slices"]


def test_a_slice_of_calls_fits_a_python_worker(spark):
    """Rows of a slice are objects in Python, as many slices at once as cores: the default must stay small and change no row."""
    import inspect

    assert inspect.signature(B.breaker_timeline).parameters["rows_per_slice"].default <= 100_000
    calls = spark.range(150_000).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("service"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"), (F.xxhash64("id") % 3 != 0).alias("ok"),
    )
    machine = B.Breaker(2, 30.0, 2, 2)
    own, whole = B.breaker_timeline(calls, machine), B.breaker_timeline(calls, machine, rows_per_slice=1_000_000)
    sums = [df.select(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first() for df in (own, whole)]
    assert sums[0] == sums[1]
