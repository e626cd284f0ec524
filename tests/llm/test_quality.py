import numpy as np
import pyarrow as pa

from billspark.llm.common import utf8_of
from billspark.llm.quality import fit, fit_documents, keep_good, rate, score_documents, text_features
from tests.llm.cases import awkward_documents, no_documents

FOLDER = "/root/testdata/sf0.01"


def features(texts):
    return text_features(*utf8_of(pa.array(texts)))


def test_thresholds_are_ordered_and_grades_follow():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    texts = [" ".join(["awful", "plain", "splendid"][g] if rng.random() < 0.8 else "word" for _ in range(3)) + f" filler{i % 40}" for i, g in enumerate(grades)]
    model = fit(features(texts[:400]), grades[:400], 3)
    assert (np.diff(model.thresholds) > 0).all()
    above = model.above(model.scores(features(texts[400:])))
    assert (np.diff(above, axis=1) <= 1e-12).all()
    assert ((above > 0.5).sum(1) == grades[400:]).mean() > 0.9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/../sf0.1/labels.parquet")
    train, test = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    scored = rate(docs, train).join(test, "doc_id").collect()
    good = [r.keep for r in scored if r.quality == 1 and r.toxic == 0]
    toxic = [r.keep for r in scored if r.toxic == 1]
    assert np.mean(good) > 0.97 and np.mean(toxic) < 0.1
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in scored)


def test_awkward_tables(spark):
    rows, docs = awkward_documents(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (6, 0, 0), (5, None, 0), (None, 1, 1), (77, 1, 1), (9, 0, 1), (2, 1, None)],
        "doc_id long, quality int, toxic int",
    )
    got = rate(docs, labels).collect()
    assert len(got) == len(rows) and len({(r.expected_grade, r.tail_probability) for r in got if r.doc_id in (2, 3)}) == 1
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    unlabelled = fit_documents(docs, labels.limit(0).selectExpr("doc_id", "quality AS grade"), 3)
    assert score_documents(docs, unlabelled).filter("abs(expected_grade - 1) < 1e-9").count() == len(rows)
    assert keep_good(docs, labels.limit(0)).count() == len(rows)
    assert rate(no_documents(spark), labels).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7}") for i in range(50)], "doc_id long, text string")
    ratings = docs.selectExpr("doc_id", "cast(doc_id % 3 as int) AS grade")
    assert len(fit_documents(docs, ratings, 3, sample=20).thresholds) == 2


def test_sample_is_taken_from_documents_that_are_there(spark):
    docs = spark.createDataFrame([(i, f"common {['awful', 'plain', 'splendid'][i % 3]} word{i % 7}") for i in range(60)], "doc_id long, text string")
    ratings = docs.selectExpr("doc_id", "cast(doc_id % 3 as int) AS grade")
    absent = spark.range(1000, 5000).selectExpr("id AS doc_id", "0 AS grade")
    want, got = (fit_documents(docs, r, 3, sample=60) for r in (ratings, ratings.unionByName(absent)))
    assert len(want.features) and (got.features == want.features).all() and np.allclose(got.weights, want.weights)


def test_whole_sample_is_fitted_and_screened_as_on_the_driver(spark, monkeypatch):
    import billspark.llm.quality as module

    docs = spark.createDataFrame([(i, f"{['awful', 'plain', 'splendid'][i % 3]} word{i % 11} extra{i % 13}") for i in range(4500)], "doc_id long, text string")
    ratings = docs.selectExpr("doc_id", "cast(doc_id % 3 as int) AS grade")
    sizes = []
    monkeypatch.setattr(module, "fit", lambda rows, *rest: (sizes.append(len(rows)), fit(rows, *rest))[1])
    got = module.fit_documents(docs, ratings, 3)
    assert sizes == [4500]
    rows = sorted(docs.collect())
    want = fit(features([r.text for r in rows]), np.array([r.doc_id % 3 for r in rows]), 3)
    assert (got.features == want.features).all() and np.allclose(got.weights, want.weights) and np.allclose(got.thresholds, want.thresholds)


def plain_features(text):
    """The documented features of one text, one byte at a time."""
    import re

    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def scramble(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def word(run):
        return scramble(sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(run)) & mask)

    data = re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode())
    words = re.findall(rb"[0-9a-z\x80-\xff]+", data)
    signs = re.findall(rb"[!-/:-@\[-`{-~]+", data)
    distinct = {word(w) for w in words}
    repeats = int(2 * np.log2((len(words) + 1) / (len(distinct) + 1)))
    found = distinct | {scramble(word(s)) for s in signs}
    found |= {scramble(1000 + repeats), scramble(2000 + min(int(8 * len(signs) / (len(words) + 1)), 16))}
    found |= {scramble(word(w[:k]) + k & mask) for k in (4, 5, 6, 7) for w in words}
    return {x >> 32 for x in found}


def test_ratings_equal_brute_force(spark):
    """Every document's features, score and grade probabilities again in plain Python, from the fitted numbers."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = fit_documents(docs, labels.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 0 ELSE quality + 1 END AS grade"), 3)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    texts = {r.doc_id: r.text or "" for r in docs.collect() if len(r.text or "") < 3000}
    got = {r.doc_id: r for r in rate(docs, labels).collect()}
    assert len(got) == docs.count() and len(weights) > 50 and len(texts) > 300
    for i, text in texts.items():
        score = sum(weights.get(f, 0.0) for f in plain_features(text))
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert abs(got[i].expected_grade - sum(above)) < 1e-6 and abs(got[i].tail_probability - above[1]) < 1e-6
        assert got[i].keep == (got[i].tail_probability >= 0.3)


def test_fit_is_at_the_minimum():
    """No small change of a weight or of all thresholds lowers the penalised likelihood noticeably."""
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 500)
    texts = [" ".join(["awful", "plain", "splendid"][g] if rng.random() < 0.7 else "word" for _ in range(3)) + f" filler{i % 9}" for i, g in enumerate(grades)]
    rows = features(texts)
    model = fit(rows, grades, 3)

    def loss(weights, thresholds):
        scores = np.array([sum(weights.get(f, 0.0) for f in r.tolist()) for r in rows])
        up = np.column_stack([np.ones(len(rows)), *(1 / (1 + np.exp(t - scores)) for t in thresholds), np.zeros(len(rows))])
        chance = up[np.arange(len(rows)), grades] - up[np.arange(len(rows)), grades + 1]
        return -np.log(chance).mean() + 0.5 * 3e-4 * sum(w * w for w in weights.values())

    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    best = loss(weights, model.thresholds)
    for f in list(weights)[:20]:
        for step in (-0.3, 0.3):
            assert loss(weights | {f: weights[f] + step}, model.thresholds) > best - 2e-3
    for step in (-0.2, 0.2):
        assert loss(weights, model.thresholds + step) > best - 2e-3
