"""Each stage of the pipeline beside a brute-force version of it on the same input."""

from tokenizers import Tokenizer

import corpus_pipeline
from billspark.llm.common import sha
from billspark.llm.line_dedup import key_of
from billspark.llm.quality import rate
from billspark.llm.vocabularies import BYTE_BPE
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_ngram_join import brute as components

FOLDER = "/root/testdata/sf0.001"


def kept_lines(docs):
    """Shared lines stay in the last of three or more documents. A document that so loses all lines long enough to
    count goes, if every line of it that is not blank also stands in a document that does not lose all."""
    lines = {i: text.split("\n") for i, text in docs.items()}
    holders = {}
    for i, own in lines.items():
        for line in own:
            if key := key_of(line):
                holders.setdefault(key, set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    kept = {i: [x for x in own if last.get(key_of(x), i) == i] for i, own in lines.items()}
    emptied = {i for i, own in lines.items() if len(kept[i]) < len(own) and not any(key_of(x) for x in kept[i])}
    elsewhere = {key_of(x, 1) for i, own in lines.items() if i not in emptied for x in own}
    gone = {i for i in emptied if all(key_of(x, 1) in elsewhere for x in lines[i] if x.strip())}
    return {i: "\n".join(kept[i]) for i in lines if i not in gone}


def test_lines_that_stand_nowhere_else_keep_their_document(spark):
    head = "A heading that many documents share"
    texts = {1: head, 2: f"{head}\nShort.", 3: f"{head}\nok", 4: f"{head}\n\nok\nA last line that is long and alone", 5: f" {head.upper()} \n \n", 6: "ok", 7: f"{head}\nOther."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, FOLDER).collect()}
    assert got == kept_lines(texts) == {2: "Short.", 4: "\nok\nA last line that is long and alone", 6: "ok", 7: f"{head}\nOther."}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns, texts = docs.columns, lambda df: {r.doc_id: r.text for r in df.collect()}
    start = texts(docs)
    good = {r.doc_id for r in rate(docs, labels).collect() if r.keep}
    stages = dict(corpus_pipeline.STAGES)
    now = stages["quality"](spark, docs, FOLDER)
    assert texts(now) == {i: t for i, t in start.items() if i in good}
    before, now = texts(now), stages["lines"](spark, now, FOLDER)
    assert texts(now) == kept_lines(before)
    before, now = texts(now), stages["near_duplicates"](spark, now, FOLDER)
    groups = components(before.items(), 5, 80)
    assert texts(now) == {i: t for i, t in before.items() if groups[i][1] == i}
    before, now = texts(now), stages["benchmark"](spark, now, FOLDER)
    after = texts(now)
    for i, text in before.items():
        words, hit = hits(text, items)[:2]
        assert (i in after) == (hit <= 0.5 * words)
        if i in after:
            assert (after[i] == text) == (hit == 0) and hits(after[i], items)[1] == 0
    assert now.columns == columns and all(r.n_chars == len(r.text) for r in now.collect())
    library = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: r for r in stages["tokens"](spark, now, FOLDER).collect()}
    assert set(got) == set(after)
    for i, text in after.items():
        assert got[i].n_tokens == len(library.encode(text, add_special_tokens=False).ids) and got[i].decoded_sha256 == sha(text.encode())


def test_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))
