import hashlib

import billspark.llm.minhash as minhash
from billspark.llm.minhash import fingerprint_documents, near_duplicates, text_signatures
from tests.llm.cases import awkward_documents, no_documents, random_texts


def shingles(text, n=5):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_estimates_jaccard():
    base = [f"w{i}" for i in range(400)]
    for cut in (0, 40, 100, 200, 300, 400):
        other = base[:cut] + [f"x{i}" for i in range(400 - cut)]
        one, two = text_signatures([" ".join(base), " ".join(other)], 5)
        assert abs((one == two).mean() - likeness(shingles(" ".join(base)), shingles(" ".join(other)))) < 0.15


def test_next_document_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE", 7)
    texts = [t * 3 for t in random_texts(1, 60)]
    docs = spark.createDataFrame([(i * 5 + 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert len(got) == 60
    for i, text in enumerate(texts):
        following, half, row = texts[(i + 1) % 60], len(text) // 2, got[i * 5 + 2]
        changed = text[: len(text) - half] + following[:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (row.near_next == 1.0) >= (text == following)
        assert abs(row.near_next - likeness(shingles(text.lower()), shingles(following.lower()))) < 0.2
    by_text = {}
    for i, text in enumerate(texts):
        assert by_text.setdefault(text, got[i * 5 + 2].fingerprint) == got[i * 5 + 2].fingerprint


def test_awkward_documents(spark):
    rows, docs = awkward_documents(spark)
    got = fingerprint_documents(docs).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _ in rows)
    one = fingerprint_documents(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    assert fingerprint_documents(no_documents(spark)).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    texts = [t for t in random_texts(4, 120, words=60)]
    rows, docs = awkward_documents(spark, texts)
    sets = {i: shingles((t or "").lower()) for i, t in rows if i is not None}
    want = {i: i for i in sets}

    def root(i):
        return i if want[i] == i else root(want[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and likeness(sets[a], sets[b]) >= 0.8 and root(a) != root(b):
                want[max(root(a), root(b))] = min(root(a), root(b))
    got = near_duplicates(docs).filter("doc_id IS NOT NULL").collect()
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in sets}
