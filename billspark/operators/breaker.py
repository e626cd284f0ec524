"""Circuit breakers replayed over ordered call outcomes.

The state after a call depends on all calls before it, so this is a fold. A service may hold a
large share of all calls, so the fold runs over slices (see ``slices``): for a slice, the state it
ends in is worked out for every state it could begin in; those small tables are chained per
service; then every slice is replayed from its true starting state. Entry states are few: the
failure counts below the threshold, the half-open counts, and "open", where only the first call at
or after the cool-down matters. Runs that meet in the same state are followed once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.functions.fixed_values import BREAKER_DEFAULT, LEAKY_BREAKER_DEFAULT
from billspark.operators.slices import sliced, slices_for

OPEN = "O"
#: Rows of a slice. A slice is held in Python as objects (about 0.6 kB a row), as many at once as an executor has cores.
ROWS_PER_SLICE = 100_000
#: Groups of services where all calls fit one slice.
IN_ONE = 64
NAMES = {"C": "CLOSED", "O": "OPEN", "H": "HALF_OPEN"}
TIMELINE = (
    "service string, ts timestamp, event_id bigint, ok boolean, allowed boolean, "
    "state_before string, state_after string, state_change boolean"
)


def manual(state, ts: int, order: str):
    """``force_open`` / ``force_close`` rows: nothing happens when already there."""
    if order == "force_open" and state[0] != OPEN:
        return (OPEN, ts), True, True
    if order == "force_close" and state[0] != "C":
        return ("C", 0), True, True
    return state, True, False


@dataclass(frozen=True)
class Breaker:
    """Consecutive-failure breaker. States: (C, failures), (O, opened at), (H, calls, successes).

    The call that moves OPEN to HALF_OPEN is not counted among the half-open calls, and that move is
    not a state change.
    """

    failure_threshold: int = BREAKER_DEFAULT[0]
    recovery_seconds: float = BREAKER_DEFAULT[1]
    half_open_calls: int = BREAKER_DEFAULT[2]
    successes_to_close: int = BREAKER_DEFAULT[3]

    def wait_us(self) -> int:
        return int(self.recovery_seconds * 1_000_000)

    def start(self):
        return ("C", 0)

    def entry_states(self):
        closed = [("C", k) for k in range(self.failure_threshold)]
        half = [
            ("H", calls, good)
            for calls in range(self.half_open_calls + 1)
            for good in range(self.successes_to_close)
        ]
        return closed + half

    def step(self, state, ts: int, ok: bool | str):
        """(next state, call allowed, counted as a state change)"""
        if isinstance(ok, str):
            return manual(state, ts, ok)
        kind = state[0]
        if kind == "C":
            if ok:
                return ("C", 0), True, False
            if state[1] + 1 >= self.failure_threshold:
                return (OPEN, ts), True, True
            return ("C", state[1] + 1), True, False
        if kind == OPEN:
            if ts - state[1] < self.wait_us():
                return state, False, False
            calls, good = 0, 0
        elif state[1] >= self.half_open_calls:
            return state, False, False
        else:
            calls, good = state[1] + 1, state[2]
        if not ok:
            return (OPEN, ts), True, True
        if good + 1 >= self.successes_to_close:
            return ("C", 0), True, True
        return ("H", calls, good + 1), True, False


@dataclass(frozen=True)
class LeakyBreaker:
    """A success takes one failure off; any number of half-open calls; cool-down from last failure."""

    failure_threshold: int = LEAKY_BREAKER_DEFAULT[0]
    cooldown_seconds: float = LEAKY_BREAKER_DEFAULT[1]
    half_open_successes: int = LEAKY_BREAKER_DEFAULT[2]

    def wait_us(self) -> int:
        return int(self.cooldown_seconds * 1_000_000)

    def start(self):
        return ("C", 0)

    def entry_states(self):
        closed = [("C", k) for k in range(self.failure_threshold)]
        return closed + [("H", k) for k in range(self.half_open_successes)]

    def step(self, state, ts: int, ok: bool | str):
        if isinstance(ok, str):
            return manual(state, ts, ok)
        kind = state[0]
        if kind == "C":
            n = max(0, state[1] - 1) if ok else state[1] + 1
            if not ok and n >= self.failure_threshold:
                return (OPEN, ts), True, True
            return ("C", n), True, False
        good = state[1] if kind == "H" else 0
        if kind == OPEN and ts - state[1] < self.wait_us():
            return state, False, False
        if not ok:
            return (OPEN, ts), True, True
        if good + 1 >= self.half_open_successes:
            return ("C", 0), True, True
        return ("H", good + 1), True, False


def _run(machine, state, times, oks, first, met):
    """State at the end from ``state`` before call ``first``; ``met[i]`` maps states seen before i."""
    trail = []
    end = None
    for i in range(first, len(times)):
        end = met[i].get(state)
        if end is not None:
            break
        trail.append((i, state))
        state = machine.step(state, times[i], oks[i])[0]
    end = state if end is None else end
    for i, seen in trail:
        met[i][seen] = end
    return end


def summarise(machine, times, oks) -> str:
    """How a slice of one service maps entry states to end states, as JSON."""
    met: list[dict] = [{} for _ in times]
    fixed = [[list(s), list(_run(machine, s, times, oks, 0, met))] for s in machine.entry_states()]
    latest_due = times[0] + machine.wait_us()
    due = []
    for i, t in enumerate(times):
        if i and times[i - 1] >= latest_due:
            break
        if i and times[i - 1] == t:
            continue
        # an "open" that falls due after the call before i and by call i
        end = list(_run(machine, (OPEN, t - machine.wait_us()), times, oks, i, met))
        if due and due[-1][1] == end:
            due[-1][0] = t
        else:
            due.append([t, end])
    return json.dumps({"fixed": fixed, "due": due})


def advance(machine, state, summary: str):
    table = json.loads(summary)
    if state[0] == OPEN:
        due_at = state[1] + machine.wait_us()
        for until, end in table["due"]:
            if due_at <= until:
                return tuple(end)
        return state
    for entry, end in table["fixed"]:
        if tuple(entry) == state:
            return tuple(end)
    raise ValueError(f"unknown state {state}")


def _pieces(pdf: pd.DataFrame):
    """Per service of one slice: name, rows in order, times in microseconds, outcomes."""
    pdf = pdf.sort_values(["service", "ts", "event_id"], kind="mergesort")
    for service, part in pdf.groupby("service", sort=False):
        times = part["ts"].astype("datetime64[us]").astype("int64").tolist()
        orders = part["action"].tolist()
        oks = [o if isinstance(o, str) else ok for o, ok in zip(orders, part["ok"].tolist())]
        yield service, part, times, oks


def breaker_timeline(
    outcomes: DataFrame, machine=None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Every call with whether it was let through and the state before and after it.

    An optional ``action`` column carries manual orders (``force_open``, ``force_close``).
    """
    machine = machine or Breaker()
    action = F.col("action") if "action" in outcomes.columns else F.lit(None)
    calls = outcomes.select("service", "ts", "event_id", "ok", action.cast("string").alias("action"))
    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part, times, oks in _pieces(pdf):
            given = part["entry"].iloc[0] if "entry" in part else None
            state = tuple(json.loads(given)) if isinstance(given, str) else machine.start()
            before, after, allowed, changed = [], [], [], []
            for t, ok in zip(times, oks):
                before.append(NAMES[state[0]])
                state, let_in, change = machine.step(state, t, ok)
                after.append(NAMES[state[0]])
                allowed.append(let_in)
                changed.append(change)
            out.append(
                part[["service", "ts", "event_id", "ok"]].assign(
                    allowed=allowed, state_before=before, state_after=after, state_change=changed
                )
            )
        return pd.concat(out)

    number = slices_for(calls, rows_per_slice)
    if number == 1:  # nothing is carried: services are replayed whole, many of them in a task
        together = F.pmod(F.xxhash64("service"), F.lit(IN_ONE)).cast("int")
        return calls.withColumn("slice_no", together).groupBy("slice_no").applyInPandas(replay, TIMELINE)
    s = sliced(calls, ["service"], ["ts", "event_id"], rows_per_slice, number)
    held = s.groupBy("slice_no", "service").agg(F.count(F.lit(1)).alias("n"))
    # services that run over several slices: at most one per slice boundary
    spanning = held.groupBy("service").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")

    def table_of(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (int(pdf["slice_no"].iloc[0]), service, summarise(machine, times, oks))
            for service, _, times, oks in _pieces(pdf)
        ]
        return pd.DataFrame(rows, columns=["slice_no", "service", "summary"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = machine.start(), []
        for r in pdf.sort_values("slice_no").itertuples(index=False):
            rows.append((r.slice_no, r.service, json.dumps(list(state))))
            state = advance(machine, state, r.summary)
        return pd.DataFrame(rows, columns=["slice_no", "service", "entry"])

    tables = (
        s.join(F.broadcast(spanning.select("service")), "service", "left_semi")
        .groupBy("slice_no")
        .applyInPandas(table_of, "slice_no int, service string, summary string")
    )
    entries = tables.groupBy("service").applyInPandas(
        chain, "slice_no int, service string, entry string"
    )

    return (
        s.join(F.broadcast(entries), ["slice_no", "service"], "left")
        .groupBy("slice_no")
        .applyInPandas(replay, TIMELINE)
    )


def breaker_stats(timeline: DataFrame) -> DataFrame:
    """Counters and last state per service; rejected calls have no result."""
    last = F.max_by("state_after", F.struct("ts", "event_id"))
    return timeline.groupBy("service").agg(
        F.count_if(~F.col("ok") & F.col("allowed")).alias("failures"),
        F.count_if(F.col("ok") & F.col("allowed")).alias("successes"),
        F.count_if(~F.col("allowed")).alias("rejected"),
        F.count_if("state_change").alias("state_changes"),
        last.alias("state"),
        F.max(F.when(F.col("state_change") & (F.col("state_after") == "OPEN"), F.col("ts"))).alias(
            "last_opened_at"
        ),
    )


def breaker_changes(timeline: DataFrame) -> DataFrame:
    """State changes as rows, the form in which change listeners consume them."""
    return timeline.filter("state_change").select(
        "service", "ts", "event_id", F.col("state_before").alias("old_state"),
        F.col("state_after").alias("new_state"),
    )
