"""Nearest vectors by randomly rotated one-bit codes, with error bounds that say what to compare exactly.

Index: from every vector the centre of all is taken; the direction of what is left is rotated at random and
each coordinate kept as one bit, packed, with two scalars: the length of the residual, and how well the
bits point along it (their inner product). Search: the rotated query is rounded to ``PLANES``
bits a coordinate, so that its inner products with all codes are ``and`` and bit counts. Divided by the
second scalar they estimate the true inner product; the error is ``BOUND`` standard deviations of a random
rotation at most (and the known error of rounding), which gives a lower bound for each distance. Vectors whose bound is
not beyond the nearest found so far are compared exactly, in double precision, with the original vectors.

Work: every query meets every vector, as blocks. Queries are dealt into blocks of bounded bytes and vectors
into chunks; a unit of work holds one block of queries and streams the codes and vectors of one chunk, and
returns k rows a query. Nothing but the centre (one number a dimension) reaches the driver.
Equal vectors are one entry of the index: of their ids only the smallest k + 1 can be among the nearest k.

Defined cases: vectors that are missing, empty, zero or hold missing or non-finite components take no part,
nor do rows without an id; vectors of different lengths are never compared. A query is an id: of rows that
repeat it the smallest vector counts; as candidates such rows all count, equal rows once. A query's own id is
no candidate. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billspark.llm.common import map_partitions, materialize, quoted

#: Standard deviations of the estimate's error that the bound allows for. 1.9 is usual; 3 misses
#: one in 700 of the vectors right at the edge of the nearest k, and hardly any further inside.
BOUND = 3.0
#: Bits of a rotated query's coordinates.
PLANES = 6
#: Bytes of queries that a unit holds, vectors of a chunk, and the fewest that make a chunk of their own.
BLOCK_BYTES, CHUNK, LEAST = 32_000_000, 131_072, 1_024
#: Vectors and queries compared at a time inside a unit.
ROWS, COLUMNS = 256, 4096


@lru_cache(4)
def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits (whole 64-bit words), length of the residual, inner product of bits and direction."""
    rest = vectors - centre
    norm = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ rotation(vectors.shape[1])
    bits = turned > 0
    fit = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    packed = np.packbits(bits, axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return packed, norm, np.where(norm > 0, fit, 1.0)


class Queries:
    """A block of queries: rotated, rounded to bit planes, and the nearest found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.keep, self.size = ids, vectors, k + 1, vectors.shape[1]
        rest = vectors - centre
        self.norm = np.linalg.norm(rest, axis=1)
        turned = (rest / np.where(self.norm > 0, self.norm, 1)[:, None]) @ rotation(self.size)
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**PLANES - 1), 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = self.low[:, None] + self.step[:, None] * levels
        self.total = rounded.sum(1)
        self.rounding = np.abs(rounded - turned).sum(1) / np.sqrt(self.size)
        planes = [np.packbits((levels >> j) & 1 == 1, axis=1, bitorder="little") for j in range(PLANES)]
        self.planes = [np.pad(p, ((0, 0), (0, -p.shape[1] % 8))).view(np.uint64) for p in planes]
        self.near = np.full((len(ids), self.keep), np.inf)  # squared distances, ascending
        self.first = np.full((len(ids), self.keep), np.iinfo(np.int64).max)  # smallest id of the entry
        self.entry = np.full((len(ids), self.keep), -1)

    def estimates(self, rows: slice, codes: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of unit residuals from packed bits, and the errors allowed for."""
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        inside = np.zeros((rows.stop - rows.start, len(codes)), np.int32)
        for j, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                inside += np.left_shift(np.bitwise_count(plane[rows, w][:, None] & codes[None, :, w]), j, dtype=np.int32)
        set_sum = self.low[rows, None] * ones[None, :] + self.step[rows, None] * inside
        root = np.sqrt(self.size)
        inner = (2 * set_sum - self.total[rows, None]) / root / fit[None, :]
        spread = BOUND * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(self.size - 1, 1))
        return inner, spread[None, :] + self.rounding[rows, None] / fit[None, :] + 1e-9

    def meet(self, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, vectors: np.ndarray, firsts: np.ndarray, entries: np.ndarray) -> int:
        """Search some entries of the index; returns how many distances were computed exactly."""
        exact = 0
        for low in range(0, len(self.ids), ROWS):
            rows = slice(low, min(low + ROWS, len(self.ids)))
            inner, error = self.estimates(rows, codes, fit)
            lengths = self.norm[rows, None] ** 2 + norm[None, :] ** 2
            cross = 2 * self.norm[rows, None] * norm[None, :]
            bound = lengths - cross * np.minimum(inner + error, 1.0)
            bound -= 1e-9 * lengths
            done = np.zeros(bound.shape, bool)
            if not np.isfinite(self.near[rows, -1]).all():  # first the most promising ones, for a bound to start from
                some = min(4 * self.keep, len(codes))
                best = np.argpartition(lengths - cross * inner, some - 1, axis=1)[:, :some]
                np.put_along_axis(done, best, True, axis=1)
                exact += self._compare(low, *np.nonzero(done), vectors, firsts, entries)
            left = (bound <= self.near[rows, -1:]) & ~done
            exact += self._compare(low, *np.nonzero(left), vectors, firsts, entries)
        return exact

    def _compare(self, low: int, q: np.ndarray, e: np.ndarray, vectors: np.ndarray, firsts: np.ndarray, entries: np.ndarray) -> int:
        if not len(q):
            return 0
        far = np.empty(len(q))
        for at in range(0, len(q), 100_000):
            part = slice(at, at + 100_000)
            far[part] = ((self.vectors[low + q[part]] - vectors[e[part]]) ** 2).sum(1)
        within = far <= self.near[low + q, -1]
        q, e, far = q[within] + low, e[within], far[within]
        asked = np.unique(q)
        if not len(asked):
            return len(within)
        owner = np.concatenate([np.repeat(asked, self.keep), q])
        near = np.concatenate([self.near[asked].ravel(), far])
        first = np.concatenate([self.first[asked].ravel(), firsts[e]])
        entry = np.concatenate([self.entry[asked].ravel(), entries[e]])
        order = np.lexsort((first, near, owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        chosen = rank < self.keep
        order, owner, rank = order[chosen], owner[chosen], rank[chosen]
        self.near[owner, rank], self.first[owner, rank], self.entry[owner, rank] = near[order], first[order], entry[order]
        return len(within)

    def answers(self, members: list[list[int]], k: int) -> Iterator[tuple[int, int, float]]:
        """``query_id, vec_id, score`` of the nearest k ids of what was met."""
        for i, own in enumerate(self.ids.tolist()):
            found = [
                (near, name)
                for near, entry in zip(self.near[i].tolist(), self.entry[i].tolist()) if entry >= 0
                for name in members[entry] if name != own
            ]
            for near, name in sorted(found)[:k]:
                yield own, name, float(np.sqrt(near))


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    found = df.select(quoted(id_column).cast("long").alias("vec_id"), quoted(vector_column).alias("vector"))
    plain = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return found.filter("vec_id IS NOT NULL AND vector IS NOT NULL").filter(plain & F.exists("vector", lambda c: c != 0))


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors of each length; a task adds up its own first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                block = matrix(column.filter(pa.array(sizes == size)))
                count, total = held.get(size, (0, 0.0))
                held[size] = (count + len(block), total + block.sum(0))
        for size, (count, total) in held.items():
            yield [[size] * size, list(range(size)), total, [count] * size]

    parts = map_partitions(rows.select("vector"), ["vector"], sums, "size int, place int, total double, n long")
    means = parts.groupBy("size", "place").agg((F.sum("total") / F.sum("n")).cast("float").alias("mean"))
    out: dict[int, np.ndarray] = {}
    for row in means.toLocalIterator():
        out.setdefault(row["size"], np.zeros(row["size"]))[row.place] = row["mean"]
    return out


def build_index(rows: DataFrame, k: int, means: dict[int, np.ndarray]) -> DataFrame:
    """``ids, vector, code, norm, fit``: each different vector once, with its smallest k + 1 ids."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_rank", F.dense_rank().over(order)).filter(F.col("_rank") <= k + 1)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    kind = dict(rows.dtypes)["vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == size))
                codes, norm, fit = encode(matrix(some.column(1)), means[size])
                yield [some.column(0), some.column(1), [c.tobytes() for c in codes], norm, fit]

    return map_partitions(entries, ["ids", "vector"], run, f"ids array<long>, vector {kind}, code binary, norm double, fit double")


def _units(batches: Iterator[pa.RecordBatch], means: dict[int, np.ndarray], k: int) -> Iterator[list]:
    """Streams rows sorted by unit, a unit's queries first; yields the nearest of each unit."""
    key, queries, waiting, members, met = None, None, [], [], []

    def finish() -> Iterator[list]:
        if queries is not None:
            rows = list(queries.answers(members, k))
            for at in range(0, len(rows), 50_000):
                yield [list(c) for c in zip(*rows[at : at + 50_000])]

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            part = batch.slice(low, high - low)
            size, unit, candidate = int(columns[0][low]), tuple(int(c[low]) for c in columns[:3]), columns[3][low]
            if unit != key:
                yield from finish()
                key, queries, waiting, members = unit, None, [], []
            if not candidate:
                waiting.append(part)
                continue
            if queries is None and waiting:
                ids = np.array([i[0] for w in waiting for i in w.column(4).to_pylist()])
                queries = Queries(ids, np.concatenate([matrix(w.column(5)) for w in waiting]), means[size], k)
                waiting = []
            for at in range(0, part.num_rows if queries else 0, COLUMNS):
                some = part.slice(at, COLUMNS)
                ids = some.column(4).to_pylist()
                codes = np.frombuffer(b"".join(some.column(6).to_pylist()), np.uint64).reshape(len(ids), -1)
                norm, fit = (some.column(c).to_numpy(zero_copy_only=False) for c in (7, 8))
                entries = np.arange(len(members), len(members) + len(ids))
                members.extend(ids)
                queries.meet(codes, norm, fit, matrix(some.column(5)), np.array([i[0] for i in ids]), entries)
    yield from finish()


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest ``k`` vectors of ``df`` to each row of ``queries``.

    Both hold ids and vectors under the names given. ``score`` is the Euclidean distance.
    """
    rows = usable(df, id_column, vector_column)
    means = centres(rows)
    index = materialize(build_index(rows, k, means), "vector-index")
    asked = usable(queries, id_column, vector_column).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = materialize(asked.filter(F.size("vector").isin(list(means)) if means else F.lit(False)), "queries")
    longest = max(means, default=1)
    blocks = max(1, -(-asked.count() // max(1, BLOCK_BYTES // (8 * longest))))
    entries, width = index.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, -(-entries // CHUNK), min(-(-width // blocks), entries // LEAST))
    one = asked.select(
        F.size("vector").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("candidate"), F.array("vec_id").alias("ids"),
        "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("fit"),
    )
    other = index.select(
        F.size("vector").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("candidate"),
        "ids", "vector", "code", "norm", "fit",
    )
    both = one.unionByName(other).withColumn("_unit", F.col("block") * chunks + F.col("chunk"))
    both = both.repartition(2 * blocks * chunks, "_unit")
    both = both.sortWithinPartitions("size", "block", "chunk", "candidate").drop("_unit")
    found = map_partitions(both, both.columns, lambda batches: _units(batches, means, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every_hundredth(df: DataFrame, k: int = 10) -> DataFrame:
    """The rows whose id is divisible by 100 as queries against all rows."""
    return nearest(df, df.filter("vec_id % 100 = 0"), k)
