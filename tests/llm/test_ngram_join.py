import pytest

import billspark.llm.ngram_join as join
from billspark.llm.components import connected_components
from billspark.llm.ngram_join import ngram_components, one_of_each
from tests.llm.cases import awkward_documents, no_documents, random_texts


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split(" ") if i is not None else []
        words = [w for part in words for w in part.split()]
        grams = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
        sets.setdefault(i, grams)
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    ids = [i for i in sets if i is not None and sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets if i is not None}


@pytest.mark.parametrize("n,percent,block", [(3, 90, None), (5, 80, None), (2, 60, 3)])
def test_equals_brute_force(spark, monkeypatch, n, percent, block):
    if block:  # many units of work for a bucket and a group
        monkeypatch.setattr(join, "BUCKET", block)
        monkeypatch.setattr(join, "GROUP", block)
    rows, docs = awkward_documents(spark, random_texts(n * 7 + percent, 150, words=60))
    rows = [(i, t) for i, t in rows if i != 9]  # its white space is not ASCII
    got = ngram_components(docs.filter("doc_id IS NULL OR doc_id <> 9"), n, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(rows, n, percent)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_one_of_each_keeps_columns(spark):
    rows, docs = awkward_documents(spark)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 9]


def test_empty(spark):
    assert ngram_components(no_documents(spark)).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (95, 95), (7, 7), (200, 200)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.vertex: r.component for r in got} == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_equal_prefix_numbers_of_one_text_count_each():
    size = 20  # of percent 80: the prefix has 5 n-grams, 15 are beyond it; 18 must be shared
    tree = join.PrefixTree(80)
    overlap = tree.needed(size, size) - tree.beyond(size)
    tokens = [7] * overlap  # shared n-grams, equal in the bits that buckets hold
    assert overlap > 1
    unit = [(1, size, 99, tokens), (2, size, 99, tokens)]
    assert join.candidates_of(unit, 80) == [(1, 2)]
    assert join.candidates_of([(1, size, 99, tokens), (2, size, 99, tokens[1:])], 80) == []
    other = (3, size, 99, [8] * overlap)
    assert {tuple(sorted(x)) for x in join.candidates_of([*unit, other], 80)} == {(1, 2)}


def test_words_that_agree_modulo_powers_of_two_stay_apart(spark):
    """The Thue-Morse word of 1024 letters and its complement have equal polynomials modulo 2^64 for every base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_components(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_hashes_depend_on_the_word_alone():
    import numpy as np
    import pyarrow as pa

    from billspark.llm.common import utf8_of
    from billspark.llm.shingles import strong_word_hashes

    words = [f"w{i}" * (i % 7 + 1) for i in range(5000)] + ["é", "漢字", "\x00", "\x00\x00", "x" * 5000]
    texts = [" ".join(words), *words, "", "\n ", " ".join(reversed(words))]
    hashes, begins = strong_word_hashes(*utf8_of(pa.array(texts, pa.large_string())))
    of = [hashes[a:b].tolist() for a, b in zip(begins, begins[1:])]
    n = len(words)
    assert of[0] == [h for x in of[1 : n + 1] for h in x] == of[-1][::-1] and of[n + 1] == of[n + 2] == []
    assert len(set(of[0])) == n and len(np.unique(hashes & np.uint64(0xFFFFFFFF))) >= n - 2
