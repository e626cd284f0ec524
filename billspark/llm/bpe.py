"""Byte-level BPE: texts to token ids and back.

A text is cut into words by the pattern of the vocabulary, special strings first. A word is encoded
over a contiguous array of ranks: the boundaries of its parts, the id of each part and the rank of
each adjacent pair are held in plain arrays; the smallest rank is searched, its boundary is deleted
and the two neighbouring ranks are looked up again, until no pair has a rank. Words longer than
``SHORT`` bytes use a heap over the same ranks, so that a text without spaces is not quadratic.

The vocabulary file is read on the driver and broadcast (50 thousand entries, about 2 MB, fixed).

Defined cases: a missing text counts as empty and gives no ids; ids outside the vocabulary are an
error when decoded; repeated rows are encoded once each; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from array import array
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from billspark.llm.common import map_batches, sha, texts_of

#: Words of more bytes are merged with a heap.
SHORT = 128
#: Encoded words that a worker remembers, about 150 bytes each.
REMEMBERED = 400_000
#: Characters of text that are cut into words at a time.
AT_A_TIME = 2_000_000
#: Row widths, in bytes, of the arrays that words are merged in together.
WIDTHS = (8, 16, 32)
#: The split pattern of byte-level vocabularies (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 30


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and token bytes of one vocabulary file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        ids, letters = spec["model"]["vocab"], byte_letters()
        bytes_of = {letter: byte for byte, letter in letters.items()}
        self.byte_ids = [ids[letters[b]] for b in range(256)]
        self.pair_rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pair_rank[(ids[left] << 20) | ids[right]] = len(self.merged)
            self.merged.append(ids[left + right])
        self.tokens: dict[int, bytes] = {i: bytes(bytes_of[c] for c in t) for t, i in ids.items() if all(c in bytes_of for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_at = [self.tokens.get(i) for i in range(max(self.tokens) + 1)]
        pairs = sorted(self.pair_rank.items())
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int32)
        self.merged_ids = np.array(self.merged, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` where there is none or either id is negative."""
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE).astype(np.int32)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of words of at most ``width`` bytes: all rows take one merge per step."""
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        places = np.arange(width)
        ids = np.where(places < lengths[:, None], np.array(self.byte_ids, np.int32)[data], -1).astype(np.int32)
        ranks = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        done, rows = ids, np.arange(len(words))
        while len(rows):
            at = ranks.argmin(1)
            lowest = ranks[np.arange(len(rows)), at]
            more = lowest < _NONE
            if not more.all():
                done[rows[~more]] = ids[~more]
                rows, ids, ranks, at, lowest = rows[more], ids[more], ranks[more], at[more], lowest[more]
            if not len(rows):
                break
            here = np.arange(len(rows))
            ids = ids.copy() if ids is done else ids
            ids[here, at] = self.merged_ids[lowest]
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], 1)
            ids = np.take_along_axis(ids, places + (places > at[:, None]), 1)
            ranks = np.concatenate([ranks, np.full((len(rows), 1), _NONE, np.int32)], 1)
            ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= at[:, None]), 1)
            left = np.maximum(at - 1, 0)
            right = np.minimum(at + 1, width - 1)
            ranks[here, left] = np.where(at > 0, self.ranks(ids[here, left], ids[here, at]), ranks[here, left])
            last = at < width - 1
            ranks[here[last], at[last]] = self.ranks(ids[here, at], ids[here, right])[last]
        counts = (done >= 0).sum(1)
        flat = done.astype(np.uint32).tobytes()
        return [flat[i : i + 4 * n] for i, n in zip(range(0, len(flat), 4 * width), counts.tolist())]


class Encoder:
    """Encodes and decodes with one vocabulary; remembers the words it has seen."""

    def __init__(self, vocabulary: Vocabulary, specials: bool = True) -> None:
        self.vocabulary = vocabulary
        self.words = regex.compile(WORDS)
        self.gaps = regex.compile(r"\s\s|\s$|\x00")
        self.special = (
            regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)))
            if specials and vocabulary.special
            else None
        )
        self.seen: dict[str, bytes] = {"\0": b""}  # words, or chunks of a few words between blanks

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word."""
        vocabulary = self.vocabulary
        ids = [vocabulary.byte_ids[b] for b in data]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank_of, merged = vocabulary.pair_rank, vocabulary.merged
        ranks = [rank_of.get((a << 20) | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == _NONE:
                break
            at = ranks.index(lowest)  # the boundary between parts at and at + 1 goes
            ids[at] = merged[lowest]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of.get((ids[at - 1] << 20) | ids[at], _NONE)
            if at < len(ranks):
                ranks[at] = rank_of.get((ids[at] << 20) | ids[at + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank_of, merged = self.vocabulary.pair_rank, self.vocabulary.merged
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [
            (rank, i)
            for i, (a, b) in enumerate(zip(ids, ids[1:]))
            if (rank := rank_of.get((a << 20) | b)) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or rank_of.get((ids[i] << 20) | ids[j]) != rank:
                continue
            ids[i], ids[j] = merged[rank], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(ids):
                    new = rank_of.get((ids[left] << 20) | ids[after[left]])
                    if new is not None:
                        heapq.heappush(heap, (new, left))
        return [i for i in ids if i >= 0]

    def pack_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words; short ones are merged together by width."""
        raw = [word.encode("utf-8", "replace") for word in words]
        out: list[bytes] = [b""] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, data in enumerate(raw):
            width = next((w for w in WIDTHS if len(data) <= w), 0)
            if width:
                groups.setdefault(width, []).append(i)
            else:
                out[i] = array("I", self.merge(data)).tobytes()
        for width, members in groups.items():
            for begin in range(0, len(members), 50_000):
                some = members[begin : begin + 50_000]
                for i, packed in zip(some, self.vocabulary.merge_rows([raw[i] for i in some], width)):
                    out[i] = packed
        return out

    def _remember(self, keys: set[str]) -> None:
        """Encode chunks whose ends are word boundaries; a chunk is one word or a few."""
        find = self.words.findall
        parts = {}
        for key in keys:
            chunk = key[1:] if key[0] == "\0" else " " + key
            parts[key] = (chunk,) if key.isalpha() else find(chunk)
        words = list({w for some in parts.values() for w in some})
        packed = dict(zip(words, self.pack_words(words)))
        for key, some in parts.items():
            self.seen[key] = packed[some[0]] if len(some) == 1 else b"".join([packed[w] for w in some])

    def _cut(self, text: str) -> list[str]:
        # A single blank between two other characters always begins a word, so texts without runs of
        # white space are split there, and the blank is left out of the key. The rest is cut by the
        # pattern as a whole; words without a blank before them have a NUL at the start of the key.
        if self.gaps.search(text):
            return ["\0" + word for word in self.words.findall(text)]
        chunks = text.split(" ")
        chunks[0] = "\0" + chunks[0]
        return chunks

    def _pieces(self, text: str) -> list[str | int]:
        """Stretches of ordinary text, and ids of special strings between them."""
        if self.special is None:
            return [text]
        out, at = [], 0
        for hit in self.special.finditer(text):
            out += [text[at : hit.start()], self.vocabulary.special[hit.group()]]
            at = hit.end()
        return [*out, text[at:] if at else text]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed native unsigned 32-bit integers."""
        out: list[bytes] = []
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= AT_A_TIME):
                size += len(texts[end])
                end += 1
            cut = [[p if isinstance(p, int) else self._cut(p) for p in self._pieces(t)] for t in texts[begin:end]]
            new: set[str] = set()
            for pieces in cut:
                for piece in pieces:
                    if not isinstance(piece, int):
                        new.update(piece)
            self._remember(new.difference(self.seen))
            get = self.seen.__getitem__
            for pieces in cut:
                out.append(
                    b"".join([array("I", [p]).tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in pieces])
                )
            if len(self.seen) > REMEMBERED:  # the first seen are the frequent ones
                self.seen = dict(islice(self.seen.items(), REMEMBERED))
            begin = end
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.vocabulary.bytes_at.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[bool, Encoder] = {}


def worker_encoder(vocabulary: Vocabulary, specials: bool) -> Encoder:
    """The encoder of this Python worker; what it remembers serves later batches and tasks."""
    encoder = _ENCODERS.get(specials)
    if encoder is None or encoder.vocabulary is not vocabulary:
        encoder = _ENCODERS[specials] = Encoder(vocabulary, specials)
    return encoder


def encode_documents(docs: DataFrame, path: str, specials: bool = True, ids: bool = False) -> DataFrame:
    """A row per document: number of ids, digest of the ids, digest of the decoded text.

    ``ids`` adds the ids as a binary column of little-endian unsigned 32-bit integers. ``specials``
    recognises the vocabulary's special strings in the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def encode(batch: pa.RecordBatch) -> list:
        encoder = worker_encoder(shared.value, specials)
        counts, digests, back, all_ids = [], [], [], []
        for packed in encoder.encode_many(texts_of(batch.column(1))):
            counts.append(len(packed) // 4)
            digests.append(sha(packed))
            back.append(sha(encoder.decode(packed).encode()))
            if ids:
                all_ids.append(packed)
        return [batch.column(0), counts, digests, back, *([all_ids] if ids else [])]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return map_batches(docs, ["doc_id", "text"], encode, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` from the ``ids`` of ``encode_documents``; missing ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def decode(batch: pa.RecordBatch) -> list:
        encoder = worker_encoder(shared.value, True)
        return [batch.column(0), [encoder.decode(p or b"") for p in batch.column(1).to_pylist()]]

    return map_batches(encoded, ["doc_id", "ids"], decode, "doc_id long, text string")
