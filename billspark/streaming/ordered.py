"""Folds over a key's rows in event-time order, however the rows are dealt over triggers.

A row waits in the state until the watermark has passed it; no row before it can come then (Spark drops
what lies behind the watermark). Released rows are folded in order, so the result is that of a batch over the
same rows, up to the watermark. State is typed: the waiting rows by column, and for each key one value that the fold
may end or let expire by a timer. Keys share a bucket's state by their hash, so that a trigger costs a call for each
bucket and not for each key, of which there may be as many as rows. What a bucket holds is bounded by the rows within
the watermark's delay and the values of its keys, which are read and written at every trigger that brings rows of it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: fold(key, state or None, released rows in order, watermark in microseconds)
#: -> (new state or None to end it, output rows, time in microseconds at which to be called again or None)
Fold = Callable[[object, "tuple | None", "list[tuple]", int], "tuple[tuple | None, list[tuple], int | None]"]


#: Buckets that keys are dealt over.
BUCKETS = 4096


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl).fields]


def fold_in_order(
    stream: DataFrame, key: str, rows: str, state: str, output: str, fold: Fold, watermark: str, time: str = "ts"
) -> DataFrame:
    """``output`` rows of ``fold`` for every ``key``.

    ``rows`` declares the columns that the fold sees, the first being ``at bigint``: ``time`` in microseconds;
    ties are in the order of the columns after it, missing values first. Rows without a time are dropped.
    """
    names, seen, value = StructType.fromDDL(output).names, _fields(rows), _fields(state)
    columns = ["_key", *[name for name, _ in seen]]
    kind = stream.schema[key].dataType.simpleString()
    # by key: its value and when it is to be called again; then the rows that wait
    kept = [("key", kind), ("due", "bigint"), *[(f"value_{n}", t) for n, t in value]]
    waits = [("waiting_key", kind), *[(f"waiting_{n}", t) for n, t in seen]]
    held = ", ".join(f"{n} array<{t}>" for n, t in kept + waits)

    def call(_, batches, group):
        until_ms = group.getCurrentWatermarkMs()
        until, values, waiting = until_ms * 1000, {}, []
        if group.exists:
            before = group.get
            values = {k: (due, tuple(v)) for k, due, *v in zip(*before[: len(kept)])}
            waiting = list(zip(*before[len(kept) :]))
        if not group.hasTimedOut:
            for part in batches:
                waiting += _plain(part[columns])
        ready = {k: [] for k, (due, _) in values.items() if due is not None and due <= until}
        rest = []
        for row in waiting:
            if row[1] <= until:
                ready.setdefault(row[0], []).append(row[1:])
            else:
                rest.append(row)
        out = []
        for k, found in ready.items():
            found.sort(key=lambda row: [(v is not None, v) for v in row])
            after, made, due = fold(k, values[k][1] if k in values else None, found, until)
            out += made
            if after is None:
                values.pop(k, None)
            else:
                values[k] = (due, tuple(after))
        if values or rest:
            group.update((*_columns([(k, due, *v) for k, (due, v) in values.items()], len(kept)), *_columns(rest, len(waits))))
            times = [row[1] for row in rest] + [due for due, _ in values.values() if due is not None]
            if times:  # a timer goes off when the watermark is beyond it
                group.setTimeoutTimestamp(max(-(-min(times) // 1000) - 1, until_ms + 1))
        elif group.exists:
            group.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    timed = stream.filter(F.col(time).isNotNull()).withWatermark(time, watermark)
    # rows without a key stay apart, since whole numbers with gaps would become floating-point ones
    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.hash(key), F.lit(BUCKETS))).otherwise(-1)
    dealt = timed.select(
        bucket.alias("_bucket"), F.col(key).alias("_key"), time, F.unix_micros(time).alias("at"), *[c for c in columns[2:] if c != time]
    )
    return dealt.groupBy("_bucket").applyInPandasWithState(call, output, held, "append", "EventTimeTimeout")


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(width)]


def _plain(part: pd.DataFrame) -> list[tuple]:
    """Rows of plain Python values, missing ones as None."""
    columns = [[None if v is None or v != v else v for v in part[c].tolist()] for c in part.columns]
    return list(zip(*columns))
