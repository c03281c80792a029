from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tests.llm.helpers import read
from tidemark.llm.queries import op12_exact_whitening
from tidemark.llm.whitening import Products, decompose, scatter, usable, whiten


def whole(rows):
    return [[floor(1024 * float(c)) + 100_000 for c in v] for v in rows]


def plain_scatter(x):
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return sums, [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("top", [3, 1 << 19, 1 << 40, 1 << 61])
def test_products_are_exact(top):
    rng = np.random.default_rng(1)
    x = rng.integers(-top, top, size=(9000 if top < 1 << 20 else 300, 3))
    made = Products(3)
    made.add(x[:100])
    made.add(x[100:])
    big = x.astype(object)
    assert (made.flush() == big.T @ big).all()


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e9])
def test_scatter_is_exact(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=5) * scale]) for i in range(400)]
    sums, expected = plain_scatter([[c - 100_000 for c in r] for r in whole(v for _, v in rows)])
    for parts in (1, 7):
        got = scatter(usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)))
        assert (got.n, got.sums, got.scatter) == (400, sums, expected)


def test_query_against_plain_code(spark, small):
    rows = [(r.vec_id, r.embedding) for r in read(spark, small, "embeddings").collect()]
    x = whole(v for _, v in rows)
    n, d = len(x), len(x[0])
    sums, square = plain_scatter(x)
    covariance = np.array([[float(Fraction(v, n * n)) for v in r] for r in square])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = op12_exact_whitening(spark, small).collect()
    assert len(got) == 8 * n
    found = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for (vec_id, _), r in zip(rows, x):
        away = [n * a - s for a, s in zip(r, sums)]
        for c in range(1, 9):
            row = found[vec_id, c]
            assert (row.n, row.deviation, row.deviation_exact) == (n, sum(a * a for a in away), str(sum(a * a for a in away)))
            plain = float(np.dot(np.array([a / n for a in away]), vectors[:, c - 1]) / np.sqrt(values[c - 1]))
            sign = signs.setdefault(c, np.sign(plain * row.whitened))
            assert row.whitened == pytest.approx(sign * plain, abs=1e-8)
            assert row.explained == pytest.approx(values[c - 1] / np.trace(covariance), rel=1e-9)
            assert row.identity_error < 1e-9


def test_small_variance_beside_large_values(spark):
    """Doubles would lose it: entries near 2 ** 40 that differ by a few units."""
    rng = np.random.default_rng(3)
    rows = [(i, [float((1 << 40) + int(a)) / 1024 for a in rng.integers(0, 9, 3)]) for i in range(500)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    w = np.array([[r.whitened for r in sorted((r for r in got if r.component == c), key=lambda r: r.vec_id)] for c in (1, 2, 3)])
    assert np.abs(np.cov(w, bias=True) - np.eye(3)).max() < 1e-9
    assert got[0].identity_error < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [0.5, 0.25]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, [-inf, 1.0]), (7, []), (8, [1.0]), (9, [1e38, 0.0])]
    table = spark.createDataFrame([(i, v, 9, 9.0) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double")
    got = whiten(table).collect()
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.component) for r in got) == [(False, 0, 1), (False, 0, 2), (True, 0, 1), (True, 0, 2), (True, 1, 1), (True, 1, 1), (True, 1, 2), (True, 1, 2)]
    assert {r.n for r in got} == {4}


def test_no_variance_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    got = whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).collect()
    assert [(r.whitened, r.explained, r.deviation) for r in got] == [(None, None, 0)] * 4
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], schema)).collect()
    assert {r.whitened is None for r in line if r.component == 1} == {False}
    assert {(r.whitened, r.explained) for r in line if r.component == 2} == {(None, 0.0)}


def test_long_overflow_is_null(spark):
    rows = [(i, [float(i % 3) * 1e12]) for i in range(3000)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None and int(r.deviation_exact) > 1 << 63 for r in got if r.vec_id % 3 == 0)


def test_decompose_signs(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(200)]
    found = decompose(scatter(usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))))
    assert all(v[np.abs(v).argmax()] > 0 for v in found.vectors.T)
