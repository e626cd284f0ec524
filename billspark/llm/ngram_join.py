"""Documents linked by the exact Jaccard similarity of their word n-gram sets, joined over prefix trees.

1. All n-grams are counted into a fixed number of cells. The order of n-grams, the same everywhere, is by
   the count of their cell and then by hash, so that n-grams of common passages come last.
2. Each distinct set is represented by its smallest document; two similar sets must share an n-gram of
   their prefixes (about a tenth of the set at 0.9), so sets meet in the buckets of prefix n-grams that
   at least two sets have.
3. A set leaves the buckets in which no other has a fitting size and enough shared prefix to come.
   In the others the rest of the shared prefixes is stored in a trie. Each set walks the trie once, sharing
   overlaps along common paths; a subtree is left as soon as the overlap so far, what can still be
   shared and what may lie beyond the prefix stay under the overlap that the sizes ask for. A set
   that is already connected to everything in the tree is not walked: a bucket gives at most as many
   candidate links as it has sets.
4. Sets connected by candidate links are compared exactly, with their whole sets, again emitting only
   links that connect something. Components of those links are the result.

Large buckets and groups are cut into blocks, and each pair of blocks is one unit of work, so memory is
bounded; every pair of sets still meets in some unit.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from billspark.llm.common import BROADCAST_IDS, drop_ids, keep_ids, map_batches, map_partitions, materialize, utf8_of
from billspark.llm.components import connected_components
from billspark.llm.shingles import ngram_sets, ngrams

#: Cells that n-grams are counted in; only the order depends on them, never the result.
CELLS = 1 << 18
#: Sets of a bucket, and whole sets of a group, that one unit of work takes from each of two blocks.
BUCKET, GROUP = 4096, 512


def cell_counts(docs: DataFrame, n: int) -> np.ndarray:
    """N-grams of all texts counted by cell: a fixed ``CELLS`` numbers, which may go to every task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, grams, _ in ngrams(*utf8_of(batch.column(0)), n):
                cells += np.bincount((grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(cells)
        yield [pa.array(used.astype(np.int32)), pa.array(cells[used])]

    rows = map_partitions(docs, ["text"], count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CELLS, np.int64)
    for row in rows.toLocalIterator():
        counts[row.cell] = row.n
    return counts


def in_order(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted positions of n-grams in the common order: level of the cell, then 52 bits of the hash."""
    level = levels[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
    return np.sort((level << np.int64(52)) | (grams >> np.uint64(12)).astype(np.int64))


def at_least(n: int, percent: int) -> int:
    """The smallest whole number that is ``percent`` of ``n`` or more."""
    return -(-percent * n // 100)


def prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``doc_id, size, d1, d2, prefix, last``: size and digest of each set, its prefix in order."""
    levels = np.floor(16 * np.log2(1.0 + counts)).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def cut(batch: pa.RecordBatch) -> list:
        levels = shared.value
        sizes, d1, d2, parts, last = [], [], [], [], []
        for grams in ngram_sets(*utf8_of(batch.column(1)), n):
            size = len(grams)
            digest = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)
            part = in_order(grams, levels)[: size - at_least(size, percent) + 1] if size else np.zeros(0, np.int64)
            sizes.append(size)
            d1.append(int(digest[0]))
            d2.append(int(digest[1]))
            parts.append(part)
            last.append(int(part[-1]) if size else None)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
        return [batch.column(0), sizes, d1, d2, lists, last]

    schema = "doc_id long, size int, d1 long, d2 long, prefix array<long>, last long"
    return map_batches(docs, ["doc_id", "text"], cut, schema)


class Links:
    """Union-find over the sets of one unit of work; collects the links that joined something."""

    def __init__(self, size: int) -> None:
        self.parent = list(range(size))
        self.groups = 0
        self.found: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.groups -= 1
        self.found.append((i, j))
        return True


class PrefixTree:
    """Ordered prefixes in a trie; a node knows what its subtree can still contribute."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.top = self._node()

    @staticmethod
    def _node() -> list:
        return [{}, 0, 0, 1 << 40, []]  # children, deepest rest, most beyond the prefix, smallest size, sets

    def needed(self, a: int, b: int) -> int:
        """Overlap that sets of sizes ``a`` and ``b`` need."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def beyond(self, size: int) -> int:
        """N-grams of a set after its prefix."""
        return at_least(size, self.percent) - 1

    def insert(self, tokens: list[int], size: int, last: int, name: int) -> None:
        node, beyond = self.top, self.beyond(size)
        for i in range(len(tokens) + 1):
            node[1] = max(node[1], len(tokens) - i)
            node[2] = max(node[2], beyond)
            node[3] = min(node[3], size)
            if i < len(tokens):
                node = node[0].setdefault(tokens[i], self._node())
        node[4].append((name, size, last))

    def fits(self, overlap: int, a: int, last_a: int, b: int, last_b: int) -> bool:
        """Whether sets with this overlap of prefixes can be similar.

        Beyond the prefix that ends first only that set's own rest can be shared.
        """
        if 100 * min(a, b) < self.percent * max(a, b):
            return False
        return overlap + self.beyond(a if last_a <= last_b else b) >= self.needed(a, b)

    def walk(self, tokens: list[int], size: int, last: int) -> Iterator[int]:
        """Names of stored sets that can be similar to this one."""
        beyond, smallest = self.beyond(size), at_least(size, self.percent)
        stack = [(self.top, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            for name, other, other_last in node[4]:
                if self.fits(overlap, size, last, other, other_last):
                    yield name
            for token, child in node[0].items():
                i = bisect_left(tokens, token, at)
                hit = i < len(tokens) and tokens[i] == token
                most = overlap + hit + min(len(tokens) - i - hit, child[1]) + max(beyond, child[2])
                if most >= self.needed(size, max(child[3], smallest)):
                    stack.append((child, i + hit, overlap + hit))


def candidates_of(unit: list[tuple[int, int, int, list[int]]], percent: int) -> list[tuple[int, int]]:
    """Candidate links of one bucket: ``(document, size, last, shared prefix from here on)``."""
    if len(unit) == 2:
        (a, size_a, last_a, tokens_a), (b, size_b, last_b, tokens_b) = unit
        overlap = (Counter(tokens_a) & Counter(tokens_b)).total()  # two n-grams of a text may be equal in 31 bits
        return [(a, b)] if a != b and PrefixTree(percent).fits(overlap, size_a, last_a, size_b, last_b) else []
    tree, links, heads = PrefixTree(percent), Links(len(unit)), []
    for i, (_, size, last, tokens) in enumerate(unit):
        links.groups += 1
        have = set(tokens)
        for head in heads[-4:]:  # most often it is connected to what is there already
            _, other, other_last, other_tokens = unit[head]
            if links.root(i) != links.root(head) and tree.fits(len(have.intersection(other_tokens)), size, last, other, other_last):
                links.join(i, head)
        if links.groups > 1:
            for name in tree.walk(tokens, size, last):
                links.join(i, name)
        if links.root(i) == i:
            heads.append(i)
        tree.insert(tokens, size, last, i)
    return [(unit[i][0], unit[j][0]) for i, j in links.found if unit[i][0] != unit[j][0]]


def verified_of(unit: list[tuple[int, set[int]]], percent: int) -> list[tuple[int, int]]:
    """Links of one group of whole sets that are similar and connect something."""
    unit = sorted(unit, key=lambda x: len(x[1]))
    links = Links(len(unit))
    for i, (_, grams) in enumerate(unit):
        for j in range(i - 1, -1, -1):
            other = unit[j][1]
            if 100 * len(other) < percent * len(grams):
                break
            if links.root(i) != links.root(j):
                both = len(grams & other)
                if 100 * both >= percent * (len(grams) + len(other) - both):
                    links.join(i, j)
    return [(unit[i][0], unit[j][0]) for i, j in links.found if unit[i][0] != unit[j][0]]


def by_unit(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows with the same first ``keys`` columns, across batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield rest
            rest = []
        for low, high in zip(cuts, cuts[1:]):
            if low:
                yield rest
                rest = []
            rest.append(batch.slice(low, high - low))
    if rest:
        yield rest


def units_of(rows: DataFrame, key: str, members: str, block: int) -> DataFrame:
    """Rows once for each unit of work they take part in: ``key``, ``i``, ``j`` and their columns.

    ``members`` counts the rows of the key; up to ``block`` rows make one unit, more are cut into
    blocks by document and every two blocks make a unit.
    """
    parts = F.ceil(F.col(members) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    cut = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).drop("_own", "_other")


def pairs_possible(sizes: np.ndarray, last: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a bucket have another that they can be similar to, if the bucket's n-gram is the
    first that they share: at most the smaller ``left`` shared prefix n-grams can follow it."""
    beyond = -(-percent * sizes // 100) - 1
    out = np.zeros(len(sizes), bool)
    for first in range(0, len(sizes), 256):
        mine = slice(first, first + 256)
        one, other = sizes[mine, None], sizes[None, :]
        rest = np.where(last[mine, None] <= last[None, :], beyond[mine, None], beyond[None, :])
        possible = np.minimum(left[mine, None], left[None, :]) + rest >= -(-percent * (one + other) // (100 + percent))
        possible &= 100 * np.minimum(one, other) >= percent * np.maximum(one, other)
        possible[np.arange(len(possible)), first + np.arange(len(possible))] = False
        out[mine] = possible.any(1)
    return out


def useful_buckets(own: DataFrame, percent: int) -> DataFrame:
    """``doc_id, size, last, token``: the buckets in which a set has a possible partner.

    Only numbers are shuffled here. Of the sets that share a passage and little else few are left.
    """
    narrow = own.select("doc_id", "size", "last", F.posexplode("own.token").alias("place", "token"), F.size("own").alias("n"))
    narrow = narrow.select("token", "doc_id", "size", "last", (F.col("n") - F.col("place")).alias("left"))
    narrow = narrow.repartition("token").sortWithinPartitions("token")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        held: list[list[np.ndarray]] = []
        for parts in by_unit(batches, 1):
            columns = [np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(5)]
            if len(columns[0]) <= 2 * BUCKET:  # larger ones are all kept
                chosen = pairs_possible(*(c.astype(np.int64) for c in (columns[2], columns[3], columns[4])), percent)
                columns = [c[chosen] for c in columns]
            if len(columns[0]):
                held.append([columns[1], columns[2], columns[3], columns[0]])
            if len(held) > 5_000:
                yield [pa.array(np.concatenate(c)) for c in zip(*held)]
                held = []
        if held:
            yield [pa.array(np.concatenate(c)) for c in zip(*held)]

    return map_partitions(narrow, narrow.columns, keep, "doc_id long, size int, last long, token long")


def candidate_links(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of sets (one row each, as from ``prefixes``) that can be similar; connects all that can."""
    tokens = sets.select("doc_id", "size", "last", F.explode("prefix").alias("token"))
    shared = tokens.withColumn("members", F.count("*").over(Window.partitionBy("token"))).filter("members > 1")
    own = shared.groupBy("doc_id", "size", "last").agg(F.sort_array(F.collect_list(F.struct("token", "members"))).alias("own"))
    own = materialize(own, "shared")
    useful = useful_buckets(own, percent).groupBy("doc_id", "size", "last").agg(F.collect_list("token").alias("useful"))
    suffixes = own.join(useful, ["doc_id", "size", "last"]).select(
        "doc_id", "size", "last", F.posexplode("own").alias("place", "first"), "own", "useful"
    ).filter(F.array_contains("useful", F.col("first.token"))).select(
        F.col("first.token").alias("token"), F.col("first.members").alias("members"), "doc_id", "size", "last",
        # 31 bits are enough here: equal ones by chance only add candidates, as overlaps count repeats
        F.expr("transform(slice(own.token, place + 1, size(own)), t -> cast(t & 2147483647 as int))").alias("rest"),
    )
    units = units_of(suffixes, "token", "members", BUCKET)
    units = units.select("token", "i", "j", "doc_id", "size", "last", "rest")
    units = units.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "size", "doc_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        a: list[int] = []
        b: list[int] = []
        for parts in by_unit(batches, 3):
            unit = [(d, n, last, sorted(rest)) for p in parts for d, n, last, rest in zip(*(p.column(k).to_pylist() for k in range(3, 7)))]
            for x, y in candidates_of(unit, percent):
                a.append(x)
                b.append(y)
            if len(a) > 50_000:
                yield [a, b]
                a, b = [], []
        yield [a, b]

    return map_partitions(units, units.columns, join, "a long, b long")


def verified_links(docs: DataFrame, groups: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b`` of documents in the same candidate group (``vertex, component``) whose sets are similar."""
    groups = materialize(groups, "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    texts = keep_ids(docs.select("doc_id", "text"), groups.select(F.col("vertex").alias("doc_id")))

    def whole(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [g.tobytes() for g in ngram_sets(*utf8_of(batch.column(1)), n)]]

    sets = map_batches(texts, ["doc_id", "text"], whole, "doc_id long, grams binary")
    placed = groups.join(sizes, "component").select(F.col("vertex").alias("doc_id"), "component", "members")
    few = groups.count() <= BROADCAST_IDS  # then whole sets are shuffled once, to their groups
    units = units_of(sets.join(F.broadcast(placed) if few else placed, "doc_id"), "component", "members", GROUP)
    units = units.select("component", "i", "j", "doc_id", "grams")
    units = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for parts in by_unit(batches, 3):
            unit = [
                (doc, set(np.frombuffer(grams, np.uint64).tolist()))
                for p in parts
                for doc, grams in zip(p.column(3).to_pylist(), p.column(4).to_pylist())
            ]
            links = verified_of(unit, percent)
            yield [[a for a, _ in links], [b for _, b in links]]

    return map_partitions(units, units.columns, compare, "a long, b long")


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of ``n`` words;
    ``component_id`` is the smallest document reachable over links, itself included. Missing and blank
    texts have an empty set and are linked with nothing; a text of fewer words has one n-gram. Rows that
    repeat a ``doc_id`` are all returned and count as linked; rows without one are returned with no
    component. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    counts = cell_counts(docs, n)
    sets = materialize(prefixes(docs, n, percent, counts), "sets")
    known = sets.filter("size > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("first")), "classes")
    firsts = known.join(classes.select("d1", "d2", F.col("first").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi")
    candidates = connected_components(candidate_links(firsts, percent))
    links = connected_components(verified_links(docs, candidates, n, percent))
    named = classes.join(links.withColumnRenamed("vertex", "first"), "first", "left").select(
        "d1", "d2", F.coalesce("component", "first").alias("component")
    )
    every = sets.select("doc_id", "size", F.when(F.col("size") > 0, F.col("d1")).alias("d1"), "d2")
    return every.join(named, ["d1", "d2"], "left").select(
        "doc_id",
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, all columns kept.

    Rows that repeat the kept ``doc_id`` stay too; rows without a ``doc_id`` stay.
    """
    found = ngram_components(docs, n, percent)
    gone = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return drop_ids(docs, gone)
