"""Passages of test items in documents, found with a suffix automaton of the items.

Texts are normalised to words: A-Z lower-cased, every other ASCII character that is not a digit or a
lower-case letter separates. All items go into one generalised suffix automaton over word numbers. A
document's words are streamed through it; after each word the state holds the longest match that ends
there. A match of ``window`` words, or of a whole item that is shorter, marks its words as hit.

Only stretches of words that all occur in items can match, so the stream skips all others (numpy) and the
automaton is stepped in stretches that are long enough for the shortest window.

Items are collected and broadcast in shards of at most ``SHARD_WORDS`` words. ``find_passages`` reads documents
once for each shard and unites the hit words; ``decontaminate`` reads them once and loads the shards in turn for
each group of documents. Either way a task holds one automaton, whatever the number of items.

Defined cases: a missing text has no words; items without words or text are ignored; repeated items, and
items with the same text, each count under their own id; a repeated item id counts once; a document that
is met in several shards has its hits united by id and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import ROWS_AT_A_TIME, fields_of, map_batches, map_partitions, texts_of

#: Words of test items that one automaton holds (about 600 bytes each).
SHARD_WORDS = 200_000
#: Bytes of documents that are held together where the automata of several shards are loaded in turn.
GROUP_BYTES = 32 << 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences that knows the items behind each window."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.after: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items_at: dict[int, set[int]] = {}  # by state: items of the window that ends there
        self.whole: dict[int, dict[int, set[int]]] = {}  # by state: items shorter than a window, by length
        self.shortest = window
        sequences = []
        for item, text in items:
            sequence = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if sequence:
                sequences.append((item, sequence))
                self.shortest = min(self.shortest, len(sequence))
                last = 0
                for number in sequence:
                    last = self._extend(last, number)
        for item, sequence in sequences:
            state, length = 0, 0
            for number in sequence:
                state, length = self._step(state, length, number)
                if length >= window:
                    at = self._ending(state, window)
                    self.items_at.setdefault(at, set()).add(item)
            if len(sequence) < window:
                at = self._ending(state, len(sequence))
                self.whole.setdefault(at, {}).setdefault(len(sequence), set()).add(item)
        self.short_above = self._short_above()

    def _extend(self, last: int, number: int) -> int:
        after, link, length = self.after, self.link, self.length
        if number in after[last]:  # met in an earlier item
            old = after[last][number]
            if length[old] == length[last] + 1:
                return old
            return self._clone(last, number, old)
        new = len(after)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and number not in after[at]:
            after[at][number] = new
            at = link[at]
        if at != -1:
            old = after[at][number]
            link[new] = old if length[old] == length[at] + 1 else self._clone(at, number, old)
        return new

    def _clone(self, at: int, number: int, old: int) -> int:
        after, link, length = self.after, self.link, self.length
        twin = len(after)
        after.append(dict(after[old]))
        link.append(link[old])
        length.append(length[at] + 1)
        link[old] = twin
        while at != -1 and after[at].get(number) == old:
            after[at][number] = twin
            at = link[at]
        return twin

    def _step(self, state: int, matched: int, number: int) -> tuple[int, int]:
        """The longest match that ends with this word."""
        after, link, length = self.after, self.link, self.length
        while state and number not in after[state]:
            state = link[state]
            matched = length[state]
        following = after[state].get(number)
        return (0, 0) if following is None else (following, matched + 1)

    def _ending(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a longer match."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _short_above(self) -> list[int]:
        """For each state the nearest one on its chain, itself included, that ends a short item; -1 for none."""
        above = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above[state] = state if state in self.whole else above[self.link[state]]
        return above

    def hits(self, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit spans of words (end exclusive, apart) and items with a window in the text."""
        words = words_of(text)
        get = self.numbers.get
        numbers = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate([[0], (numbers > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if high - low >= self.shortest:
                self._stretch(numbers[low:high].tolist(), low, spans, items)
        return len(words), _united(spans), items

    def _stretch(self, numbers: list[int], low: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        state = matched = 0
        for at, number in enumerate(numbers, low + 1):
            state, matched = self._step(state, matched, number)
            if matched >= self.window:
                spans.append((at - self.window, at))
                items |= self.items_at[self._ending(state, self.window)]
            short = self.short_above[state]
            while short > 0:
                for length, names in self.whole[short].items():
                    if length <= matched:
                        spans.append((at - length, at))
                        items |= names
                short = self.short_above[self.link[short]] if self.link[short] > 0 else -1


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def item_shards(items: DataFrame, most: int = SHARD_WORDS) -> Iterator[list[tuple[int, str]]]:
    """Items with words, fetched shard by shard; a shard has at most ``most`` words (or one item)."""
    shard: list[tuple[int, str]] = []
    size = 0
    rows = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    for item, text in rows.toLocalIterator():
        words = len(words_of(text))
        if shard and size + words > most:
            yield shard
            shard, size = [], 0
        if words:
            shard.append((item, text))
            size += words
    yield shard


def find_passages(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, spans, items``: hit spans of words and the items with a window in the text."""
    found = [_find(docs, shard, window) for shard in item_shards(items, shard_words)]
    if len(found) == 1:
        return found[0].drop("text_key")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    gathered = every.groupBy("doc_id", "n_words", "text_key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        (F.count("*") / F.lit(len(found))).cast("int").alias("times"),  # repeated rows stay as many
    )
    return gathered.select("doc_id", "n_words", F.explode(F.sequence(F.lit(1), "times")), "spans", "items").drop("col")


def _find(docs: DataFrame, shard: list[tuple[int, str]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(shard, window))

    def scan(batch: pa.RecordBatch) -> list:
        automaton = shared.value
        counts, keys, spans, items = [], [], [], []
        for text in texts_of(batch.column(1)):
            n, hit, found = automaton.hits(text)
            counts.append(n)
            keys.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
            spans.append([{"low": low, "high": high} for low, high in hit])
            items.append(sorted(found))
        return [batch.column(0), counts, keys, spans, items]

    schema = "doc_id long, n_words long, text_key binary, spans array<struct<low: int, high: int>>, items array<long>"
    return map_batches(docs, ["doc_id", "text"], scan, schema)


def _groups(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches of at most ``ROWS_AT_A_TIME`` rows; where automata must be loaded in turn, up to ``GROUP_BYTES`` together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_A_TIME):
            held.append(whole.slice(at, ROWS_AT_A_TIME))
            size += held[-1].nbytes
            if shards == 1 or size >= GROUP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _loaded(shared: Broadcast) -> Automaton:
    """The automaton of one of several shards; unlike ``value`` it is not kept, so one is held at a time."""
    path = getattr(shared, "_path", None)
    return shared.load_from_path(path) if path else shared.value


def _scanned(shards: list[Broadcast], texts: list[str]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """As ``Automaton.hits`` for each text, over the items of all shards."""
    counts = [0] * len(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for shared in shards:
        automaton = shared.value if len(shards) == 1 else _loaded(shared)
        for i, text in enumerate(texts):
            counts[i], hit, found = automaton.hits(text)
            spans[i] += hit
            items[i] |= found
        del automaton  # before the next one is loaded
    return [(n, _united(hit), found) for n, hit, found in zip(counts, spans, items)]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """A row per document: words, hit words, items with occurring windows and their digest."""
    found = find_passages(docs, items, window)
    hit = F.aggregate(
        _union_of_spans("spans"), F.lit(0).cast("long"), lambda total, s: total + (s["high"] - s["low"]).cast("long")
    )
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def _union_of_spans(column: str) -> F.Column:
    """Sorted spans without overlap; each new one begins where the one before it ends at the earliest."""
    return F.aggregate(
        F.array_sort(column),
        F.expr("named_struct('out', cast(array() as array<struct<low: int, high: int>>), 'high', 0)"),
        lambda state, s: F.struct(
            F.when(
                s["high"] > state["high"],
                F.array_append(state["out"], F.struct(F.greatest(s["low"], state["high"]).alias("low"), s["high"].alias("high"))),
            ).otherwise(state["out"]).alias("out"),
            F.greatest(state["high"], s["high"]).alias("high"),
        ),
        lambda state: state["out"],
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    if not spans:
        return text
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, at = [], 0
    for low, high in spans:
        out.append(raw[at : places[low][0]])
        at = places[high - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, most_share: float = 0.5, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``; documents hit in more than ``most_share`` of their words go.

    The spans of all shards are united before the share is tested and the text is cut. What is left after a
    cut is searched again with all shards until nothing is hit, so no window is put together by a cut and
    the result does not depend on how items fall into shards. ``n_chars``, if there is one, is set anew
    for changed texts. Other columns are kept.
    """
    context = docs.sparkSession.sparkContext
    shards = [context.broadcast(Automaton(shard, window)) for shard in item_shards(items, shard_words)]
    columns = docs.columns
    where = columns.index("text")
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for parts in _groups(batches, len(shards)):
            texts = [text for part in parts for text in part.column(where).to_pylist()]
            gone, changed, cuts = set(), set(), {}
            for i, (n, spans, _) in enumerate(_scanned(shards, [text or "" for text in texts])):
                if spans and sum(high - low for low, high in spans) > most_share * n:
                    gone.add(i)
                elif spans:
                    cuts[i] = spans
            while cuts:
                for i, spans in cuts.items():
                    texts[i] = without_spans(texts[i], spans)
                changed |= cuts.keys()
                again = _scanned(shards, [texts[i] for i in cuts])
                cuts = {i: spans for i, (_, spans, _) in zip(cuts, again) if spans}
            first = 0
            for part in parts:
                keep = [i for i in range(first, first + part.num_rows) if i not in gone]
                take = pa.array([i - first for i in keep], pa.int64())
                out = [part.column(k).take(take) for k in range(part.num_columns)]
                if changed:
                    out[where] = pa.array([texts[i] for i in keep], pa.string())
                    if chars is not None:
                        counts = part.column(chars).to_pylist()
                        out[chars] = pa.array([len(texts[i]) if i in changed else counts[i - first] for i in keep], pa.int64())
                yield out
                first += part.num_rows

    return map_partitions(docs, columns, clean, fields_of(docs, columns))
