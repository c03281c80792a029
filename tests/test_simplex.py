import random

import numpy as np
import pytest

from tidemark.plans.simplex import grid_points, least_errors, simplex_search


def every_point(rows, steps, k):
    """Losses of all grid points on all rows, as the plain rule says."""
    rows = [r for r in rows if r[-1] is not None and any(v is not None for v in r[:-1])]
    best = {}
    for p in grid_points(steps, k).tolist():
        errors = []
        for *values, y in rows:
            total = sum(w for w, v in zip(p, values) if v is not None)
            if not total:
                break
            errors.append(abs(sum(w * v for w, v in zip(p, values) if v is not None) / total - y))
        else:
            e = np.array(errors)
            for name, loss in (("mse", np.mean(e**2)), ("mae", e.mean()), ("median", np.median(e)), ("p80", np.quantile(e, 0.8))):
                best[name] = min(best.get(name, (np.inf,)), (round(float(loss), 9), tuple(p)))
    return best


@pytest.mark.parametrize(("k", "steps", "n", "missing"), [(3, 20, 300, 0.3), (4, 10, 120, 0.4), (2, 50, 60, 0.0), (3, 12, 7, 0.5)])
def test_the_same_points_as_the_whole_grid(spark, k, steps, n, missing):
    draw = random.Random(k * steps)
    rows = []
    for _ in range(n):
        y = draw.gauss(0, 1)
        rows.append((*(y + draw.gauss(0.1 * i, 0.3 + 0.2 * i) if draw.random() >= missing else None for i in range(k)), y))
    rows += [(*[None] * k, 1.0), (*[1.0] * k, None)]
    names = [f"f{i}" for i in range(k)]
    got = simplex_search(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])), names, "y", steps).collect()
    found = {r.objective: (r.loss, tuple(r[f"w{i}"] for i in range(k))) for r in got}
    expected = every_point(rows, steps, k)
    assert found.keys() == expected.keys()
    for name, (loss, p) in expected.items():
        assert found[name][0] == pytest.approx(loss, abs=2e-9)
        assert found[name][1] == p or abs(found[name][0] - loss) <= 2e-9


def test_a_fraction_of_the_grid_is_held_against_rows(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=2000)
    values = [y + rng.normal(0.2 * i, 0.3, 2000) for i in range(4)]
    rows = [(*(float(v[j]) if rng.random() > 0.2 else None for v in values), float(y[j])) for j in range(2000)]
    got = simplex_search(spark.createDataFrame(rows, "a double, b double, c double, d double, y double"), list("abcd"), "y", 50).collect()
    assert {r.objective for r in got} == {"mse", "mae", "median", "p80"} and got[0].evaluated < 0.15


def test_bounds_hold_for_every_point_of_a_box():
    rng = np.random.default_rng(9)
    values, actual = rng.normal(size=(50, 4)), rng.normal(size=50)
    held = (rng.random((50, 4)) > 0.3).astype(float)
    held[held.sum(axis=1) == 0] = 1
    values *= held
    for low, high in (([2, 0, 3], [5, 4, 3]), ([0, 0, 0], [3, 3, 3]), ([6, 0, 0], [12, 12, 2])):
        bound = least_errors(values, held, actual, np.array([low]), np.array([high]), 12)[:, 0]
        for _ in range(300):
            w = rng.integers(low, np.array(high) + 1)
            if w.sum() <= 12:
                w = np.append(w, 12 - w.sum())
                total = held @ w
                errors = np.abs(values @ w / np.where(total, total, 1) - actual)
                assert (errors[total > 0] >= bound[total > 0] - 1e-12).all()


def test_no_rows(spark):
    assert simplex_search(spark.createDataFrame([(None, 1.0)], "a double, y double"), ["a"], "y", 5).count() == 0
