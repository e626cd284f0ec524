import numpy as np

import billspark.llm.line_dedup as lines
from billspark.llm.common import sha
from billspark.llm.line_dedup import CuckooFilter, LineIndex, drop_repeated_lines, key_of, repeated_keys, split_lines
from tests.llm.cases import awkward_documents, no_documents

TEXTS = [
    "  This line stands in several documents \nshort\nonly here, number one of them",
    "THIS LINE STANDS IN SEVERAL DOCUMENTS\nonly here, number two of them\n",
    "this line stands in several documents\nthis line stands in several documents\nshort",
    "short\nshort\nshort",
    "this line stands in several documents",
    "exactly twenty chars\nexactly twenty chars",
    "exactly twenty chars\r",
    "exactly twenty chars",
    "nineteen characters",
    "nineteen characters",
    "nineteen characters",
]


def brute(rows, min_docs=3):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = key_of(line)
            if key and doc is not None:
                holders.setdefault(key, set()).add(doc)
    last = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if doc is None or last.get(key_of(x), doc) == doc]
        out.append((doc or 0, len(split), len(split) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out)


def answers(df):
    return sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_equals_brute_force(spark):
    rows, docs = awkward_documents(spark, TEXTS)
    assert answers(drop_repeated_lines(docs)) == brute(rows)
    assert drop_repeated_lines(no_documents(spark)).count() == 0


def test_many_shards_and_no_filter(spark, monkeypatch):
    rows, docs = awkward_documents(spark, TEXTS * 3)
    monkeypatch.setattr(lines, "SHARD_KEYS", 1)
    assert answers(drop_repeated_lines(docs)) == brute(rows)
    monkeypatch.setattr(lines, "FILTER_BYTES", 0)
    assert answers(drop_repeated_lines(docs)) == brute(rows)


def test_split_lines_keeps_columns_and_drops_copies(spark):
    _, docs = awkward_documents(spark, TEXTS)
    every = split_lines(docs)
    assert every.columns == docs.columns and every.count() == docs.count()
    assert every.filter("doc_id = 100").first().n_chars == len("short\nonly here, number one of them")
    some = {r.doc_id for r in split_lines(docs, copies=False).collect()}
    assert 102 not in some and 100 in some and 104 in some and 2 in some and 103 in some


def test_a_document_goes_only_if_all_its_lines_stand_elsewhere(spark, monkeypatch):
    shared = "this line stands in several documents"
    texts = {
        1: f"{shared}\nIm sich.",  # its short line stands nowhere else
        2: f"{shared}\n\n SHORT, shared \n",  # its short line stands in 5
        3: f"{shared}\ntwo emptied",  # its short line stands only in 4, which is emptied too
        4: f"{shared}\n{shared}\ntwo emptied",
        5: "short, shared\nonly this document has this line",
        6: shared,
        7: "short, shared",
        8: f"a line that has no other holder\n{shared}",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {1: "Im sich.", 3: "two emptied", 4: "two emptied", 5: texts[5], 7: texts[7], 8: texts[8]}
    assert {r.doc_id: r.text for r in split_lines(docs, copies=False).collect()} == want
    lines_of = lambda text: {x.strip().lower() for x in text.split("\n")} - {""}
    assert set().union(*map(lines_of, texts.values())) == set().union(*map(lines_of, want.values()))
    monkeypatch.setattr(lines, "FILTER_BYTES", 0)
    assert {r.doc_id: r.text for r in split_lines(docs, copies=False).collect()} == want


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    held = CuckooFilter.for_keys(keys)
    assert held.contains(keys).all()
    assert held.contains(rng.integers(-(1 << 62), 1 << 62, 20_000)).mean() < 0.01
    for key in keys[:2500]:
        assert held.delete(int(key))
    again = CuckooFilter.from_bytes(held.to_bytes())
    assert again.contains(keys[2500:]).all() and again.contains(keys[:2500]).mean() < 0.01


def test_index_is_reversible(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    more = spark.createDataFrame([(50, TEXTS[1]), (51, TEXTS[1]), (52, "only here, number one of them\n" + TEXTS[5])], "doc_id long, text string")
    first = LineIndex.of(docs)
    grown = first.insert(more)
    state = lambda index: sorted(map(tuple, index.repeated().collect()))
    assert state(grown) == sorted(map(tuple, repeated_keys(lines.line_references(docs.unionByName(more))).collect()))
    assert state(grown) != state(first)
    back = grown.delete(more.select("doc_id"))
    assert state(back) == state(first)
    for index in (grown, back):
        shared = lines.shared_filters(index.filters)
        known = lines.probable_references(docs.unionByName(more), shared, index.shards)
        keys = {(r.k1, r.k2) for r in known.collect()}
        assert {(r.k1, r.k2) for r in index.repeated().collect()} <= keys
