import random
from array import array

import pytest
from tokenizers import Tokenizer

from billspark.llm.bpe import Encoder, Vocabulary, decode_documents, encode_documents
from billspark.llm.vocabularies import BYTE_BPE
from tests.llm.cases import awkward_documents, no_documents


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(BYTE_BPE))


def ids_of(packed):
    out = array("I")
    out.frombytes(packed)
    return list(out)


def test_equals_the_library(encoder):
    theirs = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(3)
    parts = [
        "a", "the", "Heonha,", " ", "  ", "\n", "\t", "'s", "'ll", "1", "2024", "é", "Ω", "漢字", "\u00a0", "🙂", "!", "...",
        "<|endoftext|>", "\u0301", "²", "x" * 300, "ab" * 90, "\r\n", "\x00", "_", "antidisestablishmentarianism",
    ]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = theirs.encode(text, add_special_tokens=False).ids
        packed = encoder.encode(text)
        assert ids_of(packed) == want, text
        assert encoder.decode(packed) == theirs.decode(want, skip_special_tokens=False)


def test_specials_as_text():
    plain = Encoder(Vocabulary(BYTE_BPE), specials=False)
    packed = plain.encode("a<|endoftext|>b")
    assert 50256 not in ids_of(packed) and plain.decode(packed) == "a<|endoftext|>b"


def test_documents_round_trip(spark):
    rows, docs = awkward_documents(spark)
    got = encode_documents(docs, BYTE_BPE, ids=True).orderBy("doc_id").collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_tokens for r in got}[2] == 0
    back = decode_documents(encode_documents(docs, BYTE_BPE, ids=True), BYTE_BPE)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert encode_documents(no_documents(spark), BYTE_BPE).count() == 0
