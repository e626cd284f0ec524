import random

import numpy as np
import pytest

import billspark.llm.token_counts as counts
from billspark.llm.bpe import encode_documents
from billspark.llm.token_counts import count_document_tokens, read_token_files, token_counts
from billspark.llm.vocabularies import BYTE_BPE, END_OF_DOCUMENT
from tests.llm.cases import awkward_documents, no_documents

END = 9


def brute(ids):
    out, n = [], 0
    for i in ids:
        if i == END:
            out.append((len(out), n, True))
            n = 0
        else:
            n += 1
    return out + ([(len(out), n, False)] if n else [])


@pytest.mark.parametrize("size,chunk", [(1, 2), (4, 3), (64, 1024)])
def test_blocks_equal_one_pass(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(counts, "CHUNK", chunk)
    rng = random.Random(size)
    files = {f"f{k}": [END if rng.random() < p else 1 for _ in range(rng.randint(0, 120))] for k, p in enumerate((0.3, 0.02, 0, 1, 0.1))}
    files["f9"] = [END]
    rows = [
        (name, b, bytearray(np.array(ids[at : at + size], "<u2").tobytes()), "x")
        for name, ids in files.items()
        for b, at in enumerate(range(0, max(1, len(ids)), size))
    ]
    random.Random(1).shuffle(rows)
    blocks = spark.createDataFrame(rows, "file string, block long, data binary, doc_no string")
    got = {}
    for r in token_counts(blocks, END).collect():
        got.setdefault(r.file, []).append((r.doc_no, r.n_tokens, r.closed))
    assert {f: sorted(v) for f, v in got.items()} == {f: brute(i) for f, i in files.items() if i}


def test_flat_files(spark, tmp_path):
    ids = [1, 2, END, END, 3] * 50 + [4, 4]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    blocks = read_token_files(spark, str(tmp_path), block_tokens=7)
    assert blocks.count() == -(-len(ids) // 7)
    assert sorted((r.doc_no, r.n_tokens, r.closed) for r in token_counts(blocks, END).collect()) == brute(ids)


def test_documents_equal_encoder(spark):
    rows, docs = awkward_documents(spark, ["a<|endoftext|>b", "c"])
    want = sorted((r.doc_id or 0, r.n_tokens) for r in encode_documents(docs, BYTE_BPE, specials=False).collect())
    got = sorted((r.doc_id or 0, r.n_tokens) for r in count_document_tokens(docs, BYTE_BPE, END_OF_DOCUMENT).collect())
    assert got == want and len(got) == len(rows)
    assert count_document_tokens(no_documents(spark), BYTE_BPE, END_OF_DOCUMENT).count() == 0


def test_wide_ids_and_missing_pieces(spark, tmp_path, monkeypatch):
    ids = [70_000, END, 1, 2, END] * 40
    (tmp_path / "w.bin").write_bytes(np.array(ids, "<u4").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = read_token_files(spark, str(tmp_path), block_tokens=9, width=4)
    assert blocks.count() == -(-len(ids) // 9)  # none of the empty file
    assert sorted((r.doc_no, r.n_tokens, r.closed) for r in token_counts(blocks, END, "<u4").collect()) == brute(ids)
    rows, docs = awkward_documents(spark, ["a<|endoftext|>b", "c"])
    narrow = sorted((r.doc_id or 0, r.n_tokens) for r in count_document_tokens(docs, BYTE_BPE, END_OF_DOCUMENT).collect())
    far = 5_000_000  # an end beyond 16 bits makes the files wide
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_document_tokens(docs, BYTE_BPE, far).collect()) == narrow
