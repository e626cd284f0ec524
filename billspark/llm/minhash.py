"""Document fingerprints by MinHash, their likeness, and near duplicates by signature bands.

The hashes of all word n-grams of a block of texts go through ``HASHES`` universal hash functions
(odd multiplier plus offset modulo 2^32) in numpy; the smallest value per text and function is kept, mixed
and cut to 16 bits. A fingerprint is these numbers in hexadecimal; the share of equal places of two
fingerprints estimates the Jaccard similarity of the texts. Equal texts have equal fingerprints.

Defined cases: a missing text counts as empty; texts without words share one fingerprint and are linked
with nothing by ``near_duplicates``; repeated rows are answered once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import map_batches, map_partitions, materialize, sha, texts_of, utf8_of
from billspark.llm.components import connected_components
from billspark.llm.ngram_join import verified_links
from billspark.llm.shingles import ngrams

HASHES = 128
#: 21 bands of 6 places: texts of similarity 0.8 meet in a band with probability 0.998, 0.9 with 0.9999999.
BANDS, ROWS = 21, 6
#: Rows of a range of consecutive documents.
RANGE = 5_000

_RANDOM = np.random.default_rng(20240501)
_FACTORS = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)


def signatures(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """One row of ``HASHES`` unsigned 16-bit numbers for each text."""
    out = np.full((len(offsets) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    for first, grams, begins in ngrams(data, offsets, n):
        filled = np.flatnonzero(np.diff(begins))
        if len(filled):
            values, at = (grams >> np.uint64(32)).astype(np.uint32), begins[filled]
            block = np.empty((HASHES, len(filled)), np.uint32)
            for k in range(HASHES):
                np.minimum.reduceat(values * _FACTORS[k] + _OFFSETS[k], at, out=block[k])
            out[first + filled] = block.T
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def text_signatures(texts: list[str], n: int) -> np.ndarray:
    return signatures(*utf8_of(pa.array(texts, pa.large_string())), n)


def fingerprints(rows: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in rows]


def in_ranges(docs: DataFrame) -> DataFrame:
    """``range, guard, doc_id, text``: documents cut into ranges of ``doc_id``, about ``RANGE`` rows each.

    The first document of each range stands also at the end of the range before it (``guard`` = 1), that
    of the first range at the end of the last. So each row's successor is in its own range, and texts
    are shuffled once.
    """
    ids = docs.select("doc_id")
    count = ids.count()
    parts = max(1, -(-count // RANGE))
    cuts: list[int] = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts))).first()[0]
        cuts = sorted(set(found or []))
    splits = np.array(cuts, np.int64)

    def place(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        return np.where(known, np.searchsorted(splits, ids.fillna(0).to_numpy(np.int64), "right"), 0)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(place(ids).astype(np.int32))

    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least")
    firsts = sorted(ids.withColumn("range", range_of("doc_id")).groupBy("range").agg(least).collect())
    numbers = [row.range for row in firsts]
    before = {row.range: numbers[i - 1] for i, row in enumerate(firsts)}  # the first follows the last
    first_id = {row.range: row.least.doc_id for row in firsts}

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        out = []
        for own, value in zip(place(ids).tolist(), ids.tolist()):
            value = None if pd.isna(value) else int(value)
            out.append([own, before[own]] if value == first_id[own] else [own])
        return pd.Series(out)

    placed = docs.select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("guard", "range"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(max(width, len(numbers) // 8), "range")
    return placed.sortWithinPartitions("range", "guard", "doc_id", "text").select("range", "guard", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, n: int = 5) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text, and likenesses.

    The next document is the next by ``doc_id`` (missing ids first, repeated ids by text), after the last
    the first; a single document follows itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: tuple | None = None  # the last row of the batch before; its successor comes now
        for batch in batches:
            guards, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = texts_of(batch.column(3))
            if held:
                guards, ids, texts = [held[0], *guards], [held[1], *ids], [held[2], *texts]
            held = (guards[-1], ids[-1], texts[-1])
            for low in range(0, len(ids) - 1, 1000):
                high = min(low + 1000, len(ids) - 1)
                rows = [i for i in range(low, high) if not guards[i]]
                if rows:
                    yield list(_answers(rows, ids, texts, low, high, n))

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    ranged = in_ranges(docs.select("doc_id", "text"))
    return map_partitions(ranged, ranged.columns, run, schema)


def _answers(rows: list[int], ids: list, texts: list[str], low: int, high: int, n: int) -> Iterator[list]:
    own = text_signatures(texts[low : high + 1], n)
    changed = [edited(texts[i], texts[i + 1]) for i in rows]
    theirs = text_signatures(changed, n)
    at = np.array(rows) - low
    yield [ids[i] for i in rows]
    yield [len(texts[i]) for i in rows]
    yield [sha(t.encode()) for t in changed]
    yield fingerprints(own[at])
    yield fingerprints(theirs)
    yield (own[at] == theirs).mean(1).tolist()
    yield (own[at] == own[at + 1]).mean(1).tolist()


def band_links(docs: DataFrame, n: int) -> DataFrame:
    """``a, b``: each document beside the smallest one that shares a band of its signature."""

    def cut(batch: pa.RecordBatch) -> list:
        rows = signatures(*utf8_of(batch.column(1)), n)
        blank = (rows == rows[:, :1]).all(1)
        ids = batch.column(0).to_pylist()
        keep = [i for i in range(len(ids)) if ids[i] is not None and not blank[i]]
        banded = rows[keep, : BANDS * ROWS].reshape(-1, ROWS)
        keys = [row.tobytes() for row in banded]
        return [np.repeat([ids[i] for i in keep], BANDS).tolist() if keep else [], list(range(BANDS)) * len(keep), keys]

    bands = map_batches(docs, ["doc_id", "text"], cut, "doc_id long, band int, key binary").select(
        "doc_id", F.xxhash64("band", "key").alias("key")
    )
    bands = materialize(bands, "bands")
    least = bands.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("members")).filter("members > 1")
    return bands.join(least, "key").filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, class_id``: documents that meet in a band and whose n-gram sets are similar enough.

    Candidates of a band are chained to its smallest document; all sets of a chain are compared exactly,
    and ``class_id`` is the smallest document reachable over verified links (its own id without any).
    """
    docs = docs.select("doc_id", "text")
    groups = connected_components(band_links(docs, n))
    links = connected_components(verified_links(docs, groups, n, percent))
    return docs.select("doc_id").join(links.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id")
    )
