import hashlib
import random
import re

from pyspark.sql import functions as F

from billspark.llm.fill_middle import SkipList, fill_in_middle, fill_in_middle_digests, line_lengths, restored
from tests.llm.cases import awkward_documents, no_documents


def brute(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_skip_list_reaches_every_rank():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 17, 500, 5000):
        lengths = [rng.randint(0, 30) for _ in range(n)]
        lines = SkipList(lengths)
        at = 0
        for rank in range(n + 1):
            assert lines.place(rank) == at
            at += lengths[rank] if rank < n else 0
    assert len(lines.lanes) > 3 and len(lines.lanes[-1][0]) < 40


def test_lines():
    for text in ("", "\n", "\n\n", "a", "a\n", "a\nb", "\na\n\n", " a\r\nb"):
        assert line_lengths(text) == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]


def test_equal_to_brute_force_and_back(spark):
    rng = random.Random(5)
    odd = ["one <P> mark", "<S>", "x<M>", "<<P", "<S\n<\n>M>\n", "P>\nS>\n<", "\n", "\n" * 400]
    texts = odd + ["".join(rng.choice(["ab", "\n", "é🙂", "<", "S>", "M"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows, docs = awkward_documents(spark, texts)
    for rate, spm in ((100, 50), (60, 20), (0, 50)):
        out = fill_in_middle(docs, rate, spm).withColumn("text", restored(F.col("output"), F.col("form")))
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        assert got == sorted(((i, *brute(i, t, rate, spm), t or "") for i, t in rows), key=repr)


def test_digests(spark):
    rows, docs = awkward_documents(spark)
    for r in fill_in_middle_digests(docs).collect():
        text = next(t or "" for i, t in rows if i == r.doc_id)
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(brute(r.doc_id, text)[4].encode()).hexdigest()
    assert fill_in_middle_digests(no_documents(spark)).count() == 0
