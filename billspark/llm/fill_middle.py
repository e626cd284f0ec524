"""Texts rearranged so that a model learns to fill in their middle.

A text is cut into lines (each with its line end) at two places that only the document's id decides.
The cuts are found in an indexable skip list: every node stands before a line, every lane says how many
lines and how many code points lie up to the lane's next node, and a search that walks along the lanes and
down adds both up, so that it reaches the cut at a line number together with its place in the text.

Forms: ``psm`` is prefix, suffix, middle after their marks; ``spm`` is suffix, prefix, middle; ``plain`` is the
text as it is, for empty texts, for texts that hold a mark and for documents that the rate leaves out.

Defined cases: a missing text counts as empty; a missing id is hashed as no digits; a text without line ends
is one line; repeated rows are answered once each, equally; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import map_batches, texts_of
from billspark.llm.shingles import mix

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


class SkipList:
    """Lines by number: lanes of nodes, with the lines and code points from each node to the lane's next.

    Lane 0 has a node before every line; on average every fourth node of a lane also stands on the next one.
    """

    def __init__(self, lengths: list[int]) -> None:
        self.size = len(lengths)
        starts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
        tower = mix(np.arange(1, self.size + 1, dtype=np.uint64))
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []  # node on the lane below, lines, code points
        nodes, below, level = np.arange(self.size), np.arange(self.size), 0
        while len(nodes):
            places = np.append(starts[nodes], starts[-1])
            self.lanes.append((below.tolist(), np.diff(np.append(nodes, self.size)).tolist(), np.diff(places).tolist()))
            level += 1
            stays = tower[nodes] & np.uint64(4**level - 1) == 0
            stays[0] = True  # the head is on every lane
            if stays.sum() in (1, len(nodes)) or level > 30:
                break
            below = np.flatnonzero(stays)
            nodes = nodes[below]

    def place(self, rank: int) -> int:
        """The code point before line ``rank`` (0 to ``size``)."""
        node = lines = points = 0
        for below, wide, far in reversed(self.lanes):
            while lines < rank and lines + wide[node] <= rank:
                lines += wide[node]
                points += far[node]
                node += 1
            if lines == rank:
                break
            node = below[node]
        return points


def line_lengths(text: str) -> list[int]:
    """Code points of each line, its line end included."""
    *ended, last = text.split("\n")
    return [len(x) + 1 for x in ended] + ([len(last)] if last else [])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def rearranged(text: str, doc_id: int | None, rate: int, spm: int, seed: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    lines = SkipList(line_lengths(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= rate:
        return lines.size, "plain", None, None, text
    first, second = sorted((h1 % (lines.size + 1), h2 % (lines.size + 1)))
    low, high = lines.place(first), lines.place(second)
    p, s, m = MARKS
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm:
        return lines.size, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return lines.size, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``rate`` percent of the documents are rearranged, ``spm`` percent of these with the suffix first.
    """

    def run(batch: pa.RecordBatch) -> list:
        ids = batch.column(0).to_pylist()
        rows = [rearranged(t, i, rate, spm, seed) for i, t in zip(ids, texts_of(batch.column(1)))]
        return [ids, *map(list, zip(*rows))] if rows else [[]] * 6

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(docs, ["doc_id", "text"], run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone."""
    p, s, m = MARKS

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows the three marks, the last being the middle's. No text holds a mark, so the first one counts."""
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + F.lit(len(m) + 1))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests in place of the texts: of the output and of the text rebuilt from it."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
