"""Whitening against exact integers and a plain eigensolver."""

import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from placewise.llm import whitening as W
from placewise.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n string, whitened int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def run(spark, tmp_path, df):
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return op11_whitening(spark, str(tmp_path)).collect()


def exact(vectors):
    """Kept rows' integer vectors by place, the fit list's count and sums."""
    x = {i: tuple(floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fit = sorted(set(x.values()))
    return x, fit, [sum(c) for c in zip(*fit, strict=True)]


def check(rows, vectors, count):
    x, fit, sums = exact(vectors)
    n, u = len(fit), np.array(fit, float) - np.array([float(Fraction(s, len(fit))) for s in sums])
    cov = u.T @ u / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert sorted({r.vec_id for r in rows}) == sorted(x) and len(rows) == count * len(x)
    got = {(r.vec_id, r.component): r for r in rows}
    for i, v in x.items():
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) and got[i, 1].n == n
    for k in range(1, count + 1):
        assert got[next(iter(x)), k].explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
    gaps = np.abs(np.diff(np.append(values, 0)))
    for k in range(1, count + 1):  # the coordinates themselves where the eigenvalue stands alone
        if min(gaps[k - 1], gaps[k - 2] if k > 1 else np.inf) > 1e-6 * values[0]:
            z = {i: (np.array(v, float) - np.array([float(Fraction(s, n)) for s in sums])) @ basis[:, k - 1] / np.sqrt(values[k - 1]) for i, v in x.items()}
            sign = 1 if sum(z[i] * got[i, k].whitened for i in x) > 0 else -1
            assert all(got[i, k].whitened == pytest.approx(sign * z[i], abs=1e-6) for i in x)
    place = {v: i for i, v in x.items()}
    whitened = np.array([[got[place[v], k].whitened for k in range(1, count + 1)] for v in fit])
    centred = whitened - whitened.mean(axis=0)
    error = np.abs(centred.T @ centred / n - np.eye(count)).max()
    assert error < 1e-4 and all(abs(r.identity_error - error) < 1e-6 for r in rows)


def test_query_equals_plain_solver(spark, tmp_path):
    rnd = np.random.default_rng(1)
    mix = rnd.normal(size=(20, 20))
    vectors = [list(map(float, v)) for v in rnd.normal(size=(300, 20)) @ mix]
    vectors += vectors[:40] + [None, [None] * 20, [float("nan")] * 20, [float("inf"), *[0.0] * 19]]
    check(run(spark, tmp_path, frame(spark, vectors)), vectors, 16)


def test_fewer_dimensions_than_components_and_less_rank(spark, tmp_path):
    rnd = np.random.default_rng(2)
    vectors = [[float(a), float(b), float(a + b), 0.5] for a, b in rnd.integers(-9, 9, (80, 2))]
    check(run(spark, tmp_path, frame(spark, vectors)), vectors, 2)


def test_equal_eigenvalues(spark, tmp_path):
    vectors = [[float(s * 3 * (i == j)) for i in range(5)] for j in range(5) for s in (-1, 1)]
    rows = run(spark, tmp_path, frame(spark, vectors))
    check(rows, vectors, 5)
    assert all(r.explained == pytest.approx(0.2, rel=1e-12) for r in rows)


def test_a_hot_vector_and_nulls(spark):
    vectors = [[1.0, 2.0]] * 50 + [[0.0, 0.25], [3.0, -1.0], [2.0, 2.0]]
    model = W.fit(frame(spark, vectors, [None] * 53))
    assert model.n == 4 and len(model.values) == 2
    rows = W.transform(frame(spark, vectors, [None] * 53), model).collect()
    assert len(rows) == 53 and len({tuple(r.whitened) for r in rows}) == 4


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]] * 3, [[]] * 2 + [None]])
def test_nothing_to_whiten(spark, tmp_path, vectors):
    assert run(spark, tmp_path, frame(spark, vectors)) == []


def test_lengths_and_large_entries(spark):
    vectors = [[1.0, 2.0], [2.0, -1.0], [0.0, 3e7], [1.0], [1.0, 2.0, 3.0], [1e30, -1e30], [5.0, 5.0]]
    model = W.fit(frame(spark, vectors))
    assert model.dims == 2 and model.n == 5
    rows = {r.vec_id: r for r in W.transform(frame(spark, vectors), model).collect()}
    assert sorted(rows) == [0, 1, 2, 5, 6] and rows[5].deviation is None


def test_polynomial_and_roots(spark):
    rnd = random.Random(3)
    for d in (1, 2, 3, 6):
        b = [[rnd.randint(-9, 9) for _ in range(d)] for _ in range(d)]
        a = [[sum(b[i][k] * b[j][k] for k in range(d)) for j in range(d)] for i in range(d)]
        poly, common = W.characteristic(spark, a)
        rows = [[Fraction(v) for v in r] for r in a]
        want, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]  # Faddeev and LeVerrier
        for k in range(1, d + 1):
            m = [[sum(rows[i][t] * m[t][j] for t in range(d)) + (want[-1] if i == j else 0) for j in range(d)] for i in range(d)]
            want.append(-sum(sum(rows[i][t] * m[t][i] for t in range(d)) for i in range(d)) / k)
        assert poly == [int(c) for c in reversed(want)] and common == [1]
    # (x - 3)^2 (x - 7) x
    poly = [0, -63, 51, -13, 1]
    roots = W.largest_roots(poly, [-3, 1], 3)
    assert [(r.times, r.low / 2**r.bits < v <= r.high / 2**r.bits) for r, v in zip(roots, (7, 3), strict=True)] == [(1, True), (2, True)]
    close = [(1 << 80) * ((1 << 80) + 1), -(2 * (1 << 80) + 1), 1]  # two roots that differ by one in 2 ** 80
    assert [r.times for r in W.largest_roots(close, [1], 2)] == [1, 1]


def test_sums_beyond_floating_point():
    y = np.array([[1 << 40, 3], [-(1 << 41), 5]], np.int64)
    assert W.gram(y).tolist() == [[(1 << 80) + (1 << 82), 3 * (1 << 40) - 5 * (1 << 41)], [3 * (1 << 40) - 5 * (1 << 41), 34]]
    for v in (0, -1, 1 << 59, -(1 << 130) + 7, (1 << 170) - 1):
        a, b, c = W._limbs(v)
        assert a + (b << 60) + (c << 120) == v
