"""Ordered scans over keyed rows when one key may hold a large share of all rows.

A window partitioned by such a key would put a third of the table on one task. Instead rows are
range-partitioned by (key, order), so a big key is spread over many slices, each slice is scanned
alone, and what earlier slices contribute is carried in. Ranges are contiguous, so a slice has at
most one key that started in an earlier slice, and at most one that goes on in a later one: the
table of carried values has no more than two rows per slice, which is what makes it safe to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billspark.session import materialize

ROWS_PER_SLICE = 1_000_000


def slices_for(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> int:
    return max(1, math.ceil(df.count() / rows_per_slice))


def sliced(
    df: DataFrame, keys: list[str], order: list[str], rows_per_slice: int = ROWS_PER_SLICE, number: int | None = None
) -> DataFrame:
    """Rows with a ``slice_no``: contiguous ranges of (keys, order), fixed by writing them once.

    ``order`` must be unique within a key, else equal rows stay together in one slice.
    """
    n = number or slices_for(df, rows_per_slice)
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("slice_no", F.spark_partition_id())
    return materialize(ranged, "slices")


def _local(keys: list[str], order: list[str]):
    return Window.partitionBy("slice_no", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )


def _before(keys: list[str]):
    """Earlier slices of the same key; a key has at most as many summary rows as there are slices."""
    return Window.partitionBy(*keys).orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)


def _attach(df: DataFrame, carried: DataFrame, keys: list[str], present: str) -> DataFrame:
    """Join carried values; only keys that began in an earlier slice have any."""
    names = ["slice_no", *keys]
    carried = carried.filter(F.col(present).isNotNull()).withColumnsRenamed({k: f"_at{i}" for i, k in enumerate(names)})
    same = [F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(names)]  # a missing key is a key too
    return df.join(F.broadcast(carried), same, "left").drop(*[f"_at{i}" for i in range(len(names))])


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Inclusive running sums per key, one output column per entry of ``values``."""
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    s = sliced(df, keys, order, rows_per_slice)
    sums = s.groupBy("slice_no", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    carried = sums.select(
        "slice_no", *keys, *[F.sum(f"_s_{n}").over(_before(keys)).alias(f"_c_{n}") for n in values],
        F.count(F.lit(1)).over(_before(keys)).alias("_carried"),
    ).withColumn("_carried", F.when(F.col("_carried") > 0, F.col("_carried")))
    w = _local(keys, order)
    out = s
    for n in values:
        out = out.withColumn(f"_l_{n}", F.sum(f"_v_{n}").over(w))
    out = _attach(out, carried, keys, "_carried")
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    drop = [f"_{p}_{n}" for n in values for p in "vlc"]
    return out.drop("_carried", "slice_no", *drop)


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rn",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """1-based position per key, also when one key holds everything."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, rows_per_slice)


def since_reset(
    df: DataFrame, keys: list[str], order: list[str], flags: dict[str, Column],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """For each output name the length of the run of its flag's rows that ends at each row (0 where it is off).

    All flags share one sliced pass.
    """
    df = df.withColumns({f"_f_{n}": F.coalesce(flag, F.lit(False)) for n, flag in flags.items()})
    s = sliced(df, keys, order, rows_per_slice)
    w = _local(keys, order)
    s = s.withColumn("_pos", F.count(F.lit(1)).over(w))
    s = s.withColumns({f"_r_{n}": F.max(F.when(~F.col(f"_f_{n}"), F.col("_pos"))).over(w) for n in flags})
    ends = s.groupBy("slice_no", *keys).agg(
        F.max("_pos").alias("n"), *[F.max(f"_r_{n}").alias(f"_last_{n}") for n in flags]
    )
    b = _before(keys)
    placed = ends.withColumn("offset", F.coalesce(F.sum("n").over(b), F.lit(0)))
    carried = placed.select(
        "slice_no", *keys,
        F.when(F.col("offset") > 0, F.col("offset")).alias("_offset"),
        *[F.max(F.col("offset") + F.col(f"_last_{n}")).over(b).alias(f"_before_{n}") for n in flags],
    )
    out = _attach(s, carried, keys, "_offset")
    lengths = {}
    for n in flags:
        local = F.col("_pos") - F.col(f"_r_{n}")
        open_run = F.col("_pos") + F.coalesce("_offset", F.lit(0)) - F.coalesce(f"_before_{n}", F.lit(0))
        lengths[n] = F.when(F.col(f"_r_{n}").isNotNull(), local).otherwise(open_run)
    helpers = [f"_{k}_{n}" for n in flags for k in ("f", "r", "before")]
    return out.withColumns(lengths).drop("_pos", "_offset", "slice_no", *helpers)


def neighbours(
    df: DataFrame, keys: list[str], order: list[str], previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None, rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``lag``/``lead`` by one row: output name -> input column."""
    previous, following = previous or {}, following or {}
    s = sliced(df, keys, order, rows_per_slice)
    w = Window.partitionBy("slice_no", *keys).orderBy(*order)
    out = s.withColumn("_first", F.row_number().over(w) == 1).withColumn(
        "_last", F.lead(F.lit(True)).over(w).isNull()
    )
    for name, source in previous.items():
        out = out.withColumn(name, F.lag(source).over(w))
    for name, source in following.items():
        out = out.withColumn(name, F.lead(source).over(w))
    order_row = F.struct(*order)
    edge = s.groupBy("slice_no", *keys).agg(
        *[F.max_by(src, order_row).alias(f"_e_{n}") for n, src in previous.items()],
        *[F.min_by(src, order_row).alias(f"_e_{n}") for n, src in following.items()],
        F.lit(True).alias("_here"),
    )
    by_slice = Window.partitionBy(*keys).orderBy("slice_no")
    carried = edge.select(
        "slice_no", *keys,
        *[F.lag(f"_e_{n}").over(by_slice).alias(f"_c_{n}") for n in previous],
        *[F.lead(f"_e_{n}").over(by_slice).alias(f"_c_{n}") for n in following],
        F.coalesce(F.lag("_here").over(by_slice), F.lead("_here").over(by_slice)).alias("_here"),
    )
    out = _attach(out, carried, keys, "_here")
    for n in previous:
        out = out.withColumn(n, F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(n)))
    for n in following:
        out = out.withColumn(n, F.when(F.col("_last"), F.col(f"_c_{n}")).otherwise(F.col(n)))
    return out.drop("_first", "_last", "_here", "slice_no", *[f"_c_{n}" for n in [*previous, *following]])
