"""Shared helpers of the text operators: Arrow batches in and out, bounded joins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.session import materialize
from billspark.sources.tables import table

#: Rows that a task's Python code works on at a time; what it builds for them is what it holds.
ROWS_AT_A_TIME = 1_000
#: Rows of one id column that may be broadcast (8 MB); more ids are joined by shuffle.
BROADCAST_IDS = 1_000_000


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def quoted(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _by_place(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` under plain names; functions over batches take them by place."""
    return df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])


def fields_of(df: DataFrame, columns: list[str]) -> str:
    """The schema of some columns as text."""
    kinds = dict(df.dtypes)
    return ", ".join("`" + c.replace("`", "``") + "` " + kinds[c] for c in columns)


def map_batches(
    df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], list], schema: str
) -> DataFrame:
    """``fn`` takes a batch of ``columns`` and returns one list or array for each field of ``schema``.

    Batches are cut to ``ROWS_AT_A_TIME`` rows.
    """
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_A_TIME):
                out = fn(whole.slice(at, ROWS_AT_A_TIME))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, arrow)],
                    schema=arrow,
                )

    return _by_place(df, columns).mapInArrow(run, schema)


def map_partitions(
    df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str
) -> DataFrame:
    """As ``map_batches``, but ``fn`` sees all batches of a task and yields lists of columns."""
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, arrow)],
                schema=arrow,
            )

    return _by_place(df, columns).mapInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; a missing text counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows, without copying."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def keep_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids`` (one column of that name, distinct, written).

    ``ids`` is counted: up to ``most`` it is broadcast, so that texts stay where they are; above
    that the rows are shuffled on the id.
    """
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), column, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not in ``ids``; as ``keep_ids``. Rows without an id stay."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), column, "left_anti")


__all__ = ["drop_ids", "fields_of", "keep_ids", "map_batches", "map_partitions", "materialize", "quoted", "sha", "table", "texts_of", "utf8_of"]
