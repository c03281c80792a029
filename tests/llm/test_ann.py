import numpy as np
import pytest

from tests.llm.helpers import read
from tidemark.llm.ann import AnnRules, Projection, chi_square_quantile, nearest, search_cell


def brute(rows, k=20, every=20):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in usable:
        if q % every == 0:
            scores = sorted((-float(np.dot(x, y)), i) for i, y in usable if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("rules", [AnnRules(), AnnRules(cell_rows=64, leaf_rows=8)])
def test_recall_and_scores(spark, small, rules):
    table = read(spark, small, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    vectors, expected, got = dict(rows), brute(rows), by_query(nearest(table, rules))
    assert got.keys() == expected.keys()
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.dot(np.array(vectors[q], dtype=float), np.array(vectors[i], dtype=float))), rel=1e-12, abs=1e-12)
        hits += len({i for _, i, _ in found} & {i for i, _ in expected[q]})
    assert hits >= 0.9 * 20 * len(expected)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (40, [0.0, 0.0]), (8, [2.0])]
    got = by_query(nearest(spark.createDataFrame([(i, v, 9, 9) for i, v in rows], "vec_id long, embedding array<float>, rank int, cell int")))
    assert got == {0: [(1, 1, 1.0), (2, 20, 1.0), (3, 2, 0.0)], 20: [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 0.0)]}


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_chi_square_quantile():
    assert chi_square_quantile(0.95, 2) == pytest.approx(5.991464547)
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.50731306)


def test_the_stop_spares_points_and_more_of_them_in_larger_tables():
    rules, shares = AnnRules(), []
    for n in (2_000, 30_000):
        rng = np.random.default_rng(5)
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        q = x[: n : n // 100]
        projection = Projection(64, 1.0, rules.dimensions, rules.seed)
        rows, best, verified = search_cell(
            x, projection.points(x), projection.scaled(q), projection.queries(q), np.full(len(q), np.inf), 21, 1.0, chi_square_quantile(rules.certainty, rules.dimensions), rules.leaf_rows
        )
        exact = np.argsort(-(q @ x.T), axis=1)[:, :21]
        assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(rows.tolist(), exact.tolist())]) >= 0.9
        shares.append(verified / (len(q) * n))
    assert shares[1] < 0.75 * shares[0] < 0.75


def test_salted_cells_and_blocks_find_the_same(spark, small):
    table = read(spark, small, "embeddings")
    plain = by_query(nearest(table, AnnRules(certainty=0.9999999)))
    assert by_query(nearest(table, AnnRules(certainty=0.9999999, cell_rows=16, group_queries=7, sample_rows=40))) == plain
