import math
from fractions import Fraction

import numpy as np
import pytest

from billspark.llm.exact_spectrum import RealRoots, chinese_remainders, enough_primes, null_vectors, polynomials_modulo
from billspark.llm.whitening import whiten, whole_numbers

NAN, INF = float("nan"), float("inf")


def leverrier(matrix):
    """Characteristic polynomial by traces of powers, in fractions."""
    n = len(matrix)
    m, c = [[Fraction(0)] * n for _ in range(n)], [Fraction(0)] * n + [Fraction(1)]
    for k in range(1, n + 1):
        m = [[sum(matrix[i][l] * m[l][j] for l in range(n)) + (c[n - k + 1] if i == j else 0) for j in range(n)] for i in range(n)]
        c[n - k] = -sum(matrix[i][l] * m[l][i] for i in range(n) for l in range(n)) / k
    return [int(x) for x in c]


def scatter(rng, rows, size, rank=None):
    x = rng.integers(-50, 50, (rows, rank or size)) @ rng.integers(-3, 4, (rank or size, size))
    return len(x) * (x.T @ x).astype(object) - np.multiply.outer(x.sum(0).astype(object), x.sum(0).astype(object))


@pytest.mark.parametrize("size,rank", [(1, 1), (2, 2), (3, 1), (6, 6), (7, 3)])
def test_characteristic_polynomial_is_exact(size, rank):
    m = scatter(np.random.default_rng(size), 20, size, rank)
    primes = enough_primes(size, int(np.trace(m)))
    got = chinese_remainders(polynomials_modulo(m, primes), primes)
    assert got == leverrier([[Fraction(int(x)) for x in row] for row in m])


def test_polynomial_with_zero_pivots():
    for m in ([[0, 1, 0], [1, 0, 0], [0, 0, 5]], [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 2, 0], [0, 0, 0, 1]], [[3, 0, 1], [0, 3, 0], [1, 0, 3]]):
        m = np.array(m, object)
        primes = enough_primes(len(m), 30)
        assert chinese_remainders(polynomials_modulo(m, primes), primes) == leverrier([[Fraction(int(x)) for x in r] for r in m])


def test_roots_near_and_multiple():
    tiny = 10**12
    for roots in ([5, 3, 2], [7, 7, 7, 1], [tiny + 1, tiny, tiny - 1, 4], [9, 0, 0], [0, 0], [1, 1]):
        c = [1]
        for r in roots:  # constant first
            c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
        found = RealRoots(c).largest(4)
        got = [x for f in found for x in [Fraction(*(f.middle[0], 1 << f.middle[1]))] * f.times]
        want = sorted((r for r in roots if r), reverse=True)
        assert len(got) == len(want) and all(abs(g - w) <= Fraction(w, 10**25) for g, w in zip(got, want))


def test_null_vectors_of_a_multiple_root_are_orthogonal():
    m = np.array([[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 4, 0], [0, 0, 0, 1]], object)
    root = RealRoots(leverrier([[Fraction(int(x)) for x in r] for r in m])).largest(4)[0]
    v = np.array(null_vectors(m, root))
    assert root.times == 3 and np.allclose(v @ v.T, np.eye(3), atol=1e-15) and np.allclose(v[:, 3], 0, atol=1e-15)


def brute(rows, components=4):
    """Expected n, deviation, |whitened|, explained by row, from numpy's eigenvectors."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * c) for c in v] for _, v in fine]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit), fit.sum(0)
    y = (fit - np.array([Fraction(int(t), n) for t in s])).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for (i, _), row in zip(fine, x):
        deviation = sum((n * a - int(b)) ** 2 for a, b in zip(row, s))
        white = np.array([float(Fraction(n * a - int(b), n)) for a, b in zip(row, s)]) @ vectors / np.sqrt(values)
        for k in range(len(values)):
            out.append((i, k + 1, n, deviation, abs(white[k]), values[k] / (y * y).sum() * n))
    return out


def table(spark, rows, kind="float"):
    full = [(i, [None if c is None else float(c) for c in v] if v is not None else None, f"x{k}", k) for k, (i, v) in enumerate(rows)]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, x string, n int")


def agree(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.vec_id, g.component, g.n, g.deviation) == w[:4]
        assert abs(abs(g.whitened) - w[4]) < 1e-8 and abs(g.explained - w[5]) < 1e-10 and g.identity_error < 1e-9


def test_equal_to_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 9)) @ rng.normal(size=(9, 9)) * 0.3 + 2
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(None, rows[5][1]), (7, rows[7][1])]
    bad = [(2000, None), (2001, [NAN] * 9), (2002, [INF] + [0.0] * 8), (2003, [None] + [1.0] * 8), (2004, [])]
    got = whiten(table(spark, rows + bad).repartition(5)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    key = lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation, r.component)
    agree(sorted(got, key=key), sorted(brute(rows), key=order))
    for component in range(1, 5):  # one sign for all rows
        seen = {r.vec_id: r.whitened for r in got if r.component == component}
        assert seen[3] == seen[1000] == seen[1199]


def test_whole_table_is_white(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = whiten(df).collect()
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    agree(sorted(got, key=lambda r: (r.vec_id, r.component)), sorted(want, key=lambda r: r[:2]))


def test_awkward_tables(spark):
    assert whiten(table(spark, [])).count() == 0
    one = whiten(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whiten(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0])])).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.n, r.explained) for r in flat] == [(1, 1, 2, 1.0), (1, 2, 2, 0.0), (2, 1, 2, 1.0), (2, 2, 2, 0.0), (3, 1, 1, None)]
    assert [r.whitened for r in flat[:4]] == [-1.0, None, 1.0, None] and flat[0].deviation == 256**2
    huge = whiten(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1e12])], "double")).collect()
    assert {r.n for r in huge} == {3} and all(r.deviation is None for r in huge if r.vec_id < 3) and huge[0].identity_error < 1e-9
    wide = [(i, [1e9 * math.sin(i * k) for k in range(1, 4)]) for i in range(50)]
    got = sorted(whiten(table(spark, wide, "double")).collect(), key=lambda r: (r.vec_id, r.component))
    for g, w in zip(got, sorted(brute(wide), key=lambda r: r[:2])):
        assert g.deviation == (w[3] if w[3] < 2**63 else None) and abs(abs(g.whitened) - w[4]) < 1e-8


def test_whole_numbers():
    assert whole_numbers(np.array([[0.5, -0.001, -0.0, 1e300, -1e300]])).tolist() == [[128, -1, 0, 2**63 - 1, -(2**63)]]
