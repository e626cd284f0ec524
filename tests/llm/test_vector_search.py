import numpy as np
import pytest

import billspark.llm.vector_search as search
from billspark.llm.vector_search import Queries, encode, nearest, search_every_hundredth

FOLDER = "/root/testdata/sf0.1"
NAN, INF = float("nan"), float("inf")


def brute(rows, queries, k):
    """Rows of (id, vector) by the contract, in numpy."""

    def usable(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    known = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    asked = {}
    for i, v in queries:
        if i is not None and usable(v):
            asked[i] = min(asked.get(i, tuple(v)), tuple(v))
    out = []
    for i, v in asked.items():
        near = [(float(((np.array(v) - np.array(w)) ** 2).sum() ** 0.5), j) for j, w in known if j != i and len(w) == len(v)]
        out += [(i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


def table(spark, rows, kind="double"):
    full = [(i, v, f"x{n}", n) for n, (i, v) in enumerate(rows)]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, code string, chunk int")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("size", [1, 2, 7, 64, 70])
def test_equal_to_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(search, "LEAST", 100)
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * size * 5)  # several blocks of queries
    rng = np.random.default_rng(size)
    middles = rng.normal(size=(6, size))
    rows = [(i, (middles[i % 6] + 0.4 * rng.normal(size=size)).round(3).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # a hot vector, queries among its copies
    df = table(spark, rows).repartition(5)
    assert rows_of(search_every_hundredth(df)) == brute(rows, [r for r in rows if r[0] % 100 == 0], 10)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (100, [1.0, 2.5]), (200, None), (300, []), (400, [0.0, 0.0]), (500, [1.0, None]), (600, [NAN, 1.0]),
        (700, [INF, 1.0]), (None, [1.0, 2.1]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [3.0, 4.0]), (7, [1.0, 2.0, 3.0]), (800, [1.0, 2.0, 3.5]),
        (900, [5.0]), (0, [9.0, 9.0]), (8, [-0.0, 1.0]), (9, [0.0, 1.0]),
    ]
    df = table(spark, rows)
    assert rows_of(search_every_hundredth(df, 3)) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 3)
    none = table(spark, [])
    assert search_every_hundredth(none).count() == 0
    assert nearest(df, none).count() == 0 and nearest(none, df).count() == 0
    assert rows_of(nearest(df, df, 1)) == brute(rows, rows, 1)


def test_bounds_hold_and_spare_most_comparisons():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(5000, 64))
    centre = vectors.mean(0)
    codes, norm, fit = encode(vectors, centre)
    words = codes.view(np.uint64)
    asked = Queries(np.arange(50), vectors[:50], centre, 10)
    inner, error = asked.estimates(slice(0, 50), words, fit)
    rest = vectors - centre
    true = (rest[:50] / asked.norm[:50, None]) @ (rest / norm[:, None]).T
    assert (np.abs(inner - true) > error).mean() < 4e-3
    assert np.corrcoef(inner.ravel(), true.ravel())[0, 1] > 0.75
    exact = asked.meet(words, norm, fit, vectors, np.arange(5000), np.arange(5000))
    assert exact < 0.65 * 50 * 5000


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, [r for r in rows if r[0] % 100 == 0], 10)}
    got = {(r.query_id, r.vec_id) for r in search_every_hundredth(df).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)
