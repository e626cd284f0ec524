"""Lines that many documents share, dropped everywhere but in the last document that holds them.

The exact state is a table of references, one row for each (key of a line, document). Counting its
rows by key gives the repeated keys and the document that keeps each. Sharded cuckoo filters hold the
fingerprints of the repeated keys; a document's lines are asked there first, and only lines that a filter
knows go on to be joined with the exact counts, so a false positive never drops a line.

References can be inserted and documents deleted: both change the references, and the keys that become
repeated or cease to be are put into or taken out of the filters of their shards (``LineIndex``).

A line's key is the line without ASCII white space at its ends, A-Z lower-cased, as a 128-bit hash.

Defined cases: a missing or empty text is one empty line; lines with keys shorter than ``min_chars`` code
points always stay; a key twice in one document counts once; rows that repeat a ``doc_id`` count as one
document and keep or lose a line together; rows without a ``doc_id`` are neither counted nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import drop_ids, fields_of, keep_ids, map_batches, materialize, quoted, sha, texts_of

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of one filter shard (about 3 bytes each); filters of all shards up to ``FILTER_BYTES`` are broadcast.
SHARD_KEYS, FILTER_BYTES = 200_000, 64 << 20
_BLANK = " \t\n\x0b\x0c\r"


def key_of(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Sixteen bytes, or none for a line that is too short to count."""
    line = line.strip(_BLANK)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "replace").lower()) if len(line) >= min_chars else None


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class CuckooFilter:
    """Fingerprints of 64-bit keys in buckets of four; each has two buckets, either found from the other."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None) -> None:
        self.mask = buckets - 1
        self.slots = np.zeros((buckets, 4), np.uint16) if slots is None else slots

    @staticmethod
    def for_keys(keys: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) / 3.2))))
        while True:
            made = CuckooFilter(buckets)
            if all(made.insert(int(k)) for k in keys):
                return made
            buckets *= 2

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16).reshape(-1, 4).copy()
        return CuckooFilter(len(slots), slots)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _print_of(self, keys: np.ndarray) -> np.ndarray:
        prints = (keys.view(np.uint64) >> np.uint64(48)).astype(np.int64)
        return np.where(prints == 0, 1, prints)

    def _other(self, bucket, prints):
        return (bucket ^ (prints * 0x5BD1E995)) & self.mask

    def _places(self, key: int) -> tuple[int, int, int]:
        one = np.array([key], np.int64)
        mark = int(self._print_of(one)[0])
        first = int(one[0]) & self.mask
        return mark, first, int(self._other(first, mark))

    def insert(self, key: int) -> bool:
        """False if no place was found; the filter must then be made anew, larger."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            if free := np.flatnonzero(self.slots[bucket] == 0).tolist():
                self.slots[bucket, free[0]] = mark
                return True
        bucket = second
        for turn in range(500):
            slot = turn & 3
            mark, self.slots[bucket, slot] = int(self.slots[bucket, slot]), mark
            bucket = int(self._other(bucket, mark))
            if free := np.flatnonzero(self.slots[bucket] == 0).tolist():
                self.slots[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        """Take out one fingerprint of a key that was inserted."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            if held := np.flatnonzero(self.slots[bucket] == mark).tolist():
                self.slots[bucket, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks = self._print_of(keys)
        first = keys & self.mask
        second = self._other(first, marks)
        found = (self.slots[first] == marks[:, None]).any(1)
        return found | (self.slots[second] == marks[:, None]).any(1)


def line_references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``k1, k2, doc_id``: each key of each document once."""

    def cut(batch: pa.RecordBatch) -> list:
        keys, ids = [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            if doc is not None:
                own = {key_of(line, min_chars) for line in text.split("\n")} - {None}
                keys += own
                ids += [doc] * len(own)
        return [*_halves(keys), ids]

    return map_batches(docs, ["doc_id", "text"], cut, "k1 long, k2 long, doc_id long").distinct()


def repeated_keys(references: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``k1, k2, n_docs, last``: keys of at least ``min_docs`` documents and the largest that holds each."""
    counts = references.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
    return counts.filter(F.col("n_docs") >= min_docs)


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """``shard, filter``: a cuckoo filter of the keys of each shard (by their second half)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.for_keys(pdf["k1"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [made.to_bytes()]})

    placed = keys.select("k1", F.pmod("k2", F.lit(shards)).cast("int").alias("shard"))
    return placed.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def shared_filters(filters: DataFrame):
    """The filters as a broadcast, or None if they are too large for that."""
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size > FILTER_BYTES:
        return None
    return filters.sparkSession.sparkContext.broadcast({row.shard: bytes(row.filter) for row in filters.toLocalIterator()})


def probable_references(docs: DataFrame, shared, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """The references of ``docs`` that the filters know: all repeated keys and few others."""

    def probe(batch: pa.RecordBatch) -> list:
        filters = {shard: CuckooFilter.from_bytes(data) for shard, data in shared.value.items()}
        keys, ids = [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            if doc is not None:
                own = {key_of(line, min_chars) for line in text.split("\n")} - {None}
                keys += own
                ids += [doc] * len(own)
        k1, k2 = _halves(keys)
        known = np.zeros(len(k1), bool)
        home = k2 % shards
        for shard, held in filters.items():
            mine = np.flatnonzero(home == shard)
            known[mine] = held.contains(k1[mine])
        return [k1[known], k2[known], np.array(ids, np.int64)[known]]

    return map_batches(docs, ["doc_id", "text"], probe, "k1 long, k2 long, doc_id long")


@dataclass(frozen=True)
class LineIndex:
    """Exact references with the filters of the keys that are repeated among them."""

    references: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @staticmethod
    def of(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        references = materialize(line_references(docs, min_chars), "references")
        keys = repeated_keys(references, min_docs)
        shards = shards_for(keys.count())
        return LineIndex(references, materialize(build_filters(keys, shards), "filters"), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the lines of further documents."""
        return self._changed(self.references.unionByName(line_references(docs, self.min_chars)).distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of ``ids`` (``doc_id``)."""
        return self._changed(self.references.join(ids.select("doc_id").distinct(), "doc_id", "left_anti"))

    def repeated(self) -> DataFrame:
        return repeated_keys(self.references, self.min_docs)

    def _changed(self, references: DataFrame) -> LineIndex:
        references = materialize(references.select("k1", "k2", "doc_id"), "references")
        before, now = self.repeated().select("k1", "k2"), repeated_keys(references, self.min_docs).select("k1", "k2")
        turned = now.exceptAll(before).withColumn("gain", F.lit(True)).unionByName(
            before.exceptAll(now).withColumn("gain", F.lit(False))
        )
        turned = turned.withColumn("shard", F.pmod("k2", F.lit(self.shards)).cast("int"))

        def update(key, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            data = old["filter"].iloc[0] if len(old) else CuckooFilter(16).to_bytes()
            held = CuckooFilter.from_bytes(data)
            for k1 in changes.loc[~changes["gain"].astype(bool), "k1"]:
                held.delete(int(k1))
            full = not all([held.insert(int(k1)) for k1 in changes.loc[changes["gain"].astype(bool), "k1"]])
            return pd.DataFrame({"shard": [int(key[0])], "filter": [None if full else held.to_bytes()]})

        filters = (
            self.filters.groupBy("shard").cogroup(turned.groupBy("shard")).applyInPandas(update, "shard int, filter binary")
        )
        filters = materialize(filters, "filters")
        index = LineIndex(references, filters, self.shards, self.min_docs, self.min_chars)
        if filters.filter("filter IS NULL").limit(1).count():  # a shard is full: make the filters anew, larger
            keys = index.repeated()
            shards = shards_for(keys.count())
            index = LineIndex(references, materialize(build_filters(keys, shards), "filters"), shards, self.min_docs, self.min_chars)
        return index


def lines_to_drop(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, drop``: for each document that loses lines, the keys of these (packed, sixteen bytes each)."""
    repeated = materialize(repeated_keys(line_references(docs, min_chars), min_docs), "repeated")
    shards = shards_for(repeated.count())
    shared = shared_filters(build_filters(repeated, shards))
    if shared is None:
        asked = line_references(docs, min_chars)
    else:
        asked = probable_references(docs, shared, shards, min_chars).distinct()
    lost = asked.join(repeated, ["k1", "k2"]).filter("doc_id <> last")
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("drop"))


def held_elsewhere(docs: DataFrame, drop: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id`` of documents that lose every line long enough to count, if each other line of theirs that
    is not blank, however short, stands in a document that does not.

    ``drop`` is written, as from ``lines_to_drop``.
    """

    def count(batch: pa.RecordBatch) -> list:
        own = ({key_of(line, min_chars) for line in text.split("\n")} - {None} for text in texts_of(batch.column(1)))
        return [batch.column(0), [len(keys) for keys in own]]

    counts = map_batches(docs, ["doc_id", "text"], count, "doc_id long, n long").groupBy("doc_id").agg(F.max("n").alias("n"))
    emptied = drop.select("doc_id", F.size("drop").alias("lost")).join(counts, "doc_id").filter("lost >= n").select("doc_id")
    emptied = materialize(emptied, "emptied")
    own = materialize(line_references(keep_ids(docs, emptied), 1), "emptied-lines")
    keys = own.select("k1", "k2").distinct()
    shards = shards_for(keys.count())
    shared = shared_filters(build_filters(keys, shards))
    others = drop_ids(docs, emptied)
    held = line_references(others, 1) if shared is None else probable_references(others, shared, shards, 1)
    alone = own.join(held.select("k1", "k2").distinct(), ["k1", "k2"], "left_anti")
    return emptied.join(alone.select("doc_id").distinct(), "doc_id", "left_anti")


def split_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, copies: bool = True, digest: bool = False
) -> DataFrame:
    """``docs`` without the lines to drop; all columns are kept and ``n_chars``, if there is one, is set anew.

    With ``digest`` the rows are ``doc_id``, ``n_lines`` before dropping, ``n_dropped``, ``kept_sha256``. Without ``copies`` documents go that had lines long enough to count and
    lost all of them, if their shorter lines too stand in documents that stay (``held_elsewhere``).
    """
    drop = lines_to_drop(docs.select("doc_id", "text"), min_docs, min_chars)
    if copies:
        drop = drop.withColumn("goes", F.lit(False))
    else:
        drop = materialize(drop, "drop")
        goes = held_elsewhere(docs.select("doc_id", "text"), drop, min_chars).withColumn("goes", F.lit(True))
        drop = drop.join(goes, "doc_id", "left").select("doc_id", "drop", F.coalesce("goes", F.lit(False)).alias("goes"))
    columns = ["doc_id", "text"] if digest else docs.columns
    names = {c: f"c{i}" for i, c in enumerate(columns)}  # any name of the caller's may clash with "drop"
    joined = docs.select(*(quoted(c).alias(n) for c, n in names.items())).join(
        drop.select(F.col("doc_id").alias(names["doc_id"]), "drop", "goes").hint("shuffle_hash"), names["doc_id"], "left"
    )
    where, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns and not digest else None
    some = [*names.values(), "drop", "goes"]

    def cut(batch: pa.RecordBatch) -> list:
        texts = batch.column(where).to_pylist()
        lost, goes = batch.column(len(columns)), batch.column(len(columns) + 1).to_pylist()
        lines, dropped, keep, changed = [], [], [], set()
        for i, text in enumerate(texts):
            split = (text or "").split("\n")
            gone, left = 0, False
            if lost[i].is_valid:
                keys = {np.array([d["k1"], d["k2"]], np.int64).tobytes() for d in lost[i].as_py()}
                own = [key_of(line, min_chars) for line in split]
                kept = [line for line, key in zip(split, own) if key not in keys]
                gone, left = len(split) - len(kept), any(key is not None and key not in keys for key in own)
                if gone:
                    texts[i] = "\n".join(kept)
                    changed.add(i)
            if left or not gone or not goes[i]:
                keep.append(i)
            lines.append(len(split))
            dropped.append(gone)
        if digest:
            return [batch.column(0), lines, dropped, [sha((t or "").encode()) for t in texts]]
        take = pa.array(keep, pa.int64())
        out = [batch.column(k).take(take) for k in range(len(columns))]
        out[where] = pa.array([texts[i] for i in keep], pa.string())
        if chars is not None:
            counts = batch.column(chars).to_pylist()
            out[chars] = pa.array([len(texts[i]) if i in changed else counts[i] for i in keep], pa.int64())
        return out

    if digest:
        return map_batches(joined, some, cut, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return map_batches(joined, some, cut, fields_of(docs, columns))


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row per document: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    return split_lines(docs, min_docs, min_chars, digest=True)
