import random
from itertools import groupby

import numpy as np
import pytest

from tidemark.plans.nested import nested_selection

FEATURES = ["a", "b", "c"]
POLICIES = [((), 0.0), (("a",), 0.5), (("a", "b"), 0.5), (("a", "b", "c"), 0.0), (("a", "b", "c"), 8.0), (("c",), 8.0)]


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(6), []
    for g in range(6):
        shift = draw.gauss(0, 1)
        for _ in range(draw.randrange(5, 30)):
            a, b, c = (draw.gauss(shift, 1) for _ in range(3))
            out.append((f"g{g}", draw.randrange(5), a, b, c, 1.0 + 0.8 * a - 0.3 * b + draw.gauss(0, 0.5) + 0.2 * shift))
    return [*out, ("g0", 1, None, 1.0, 1.0, 1.0), ("new", 4, 0.1, 0.2, 0.3, 1.0)]


def fit(rows, policy):
    held = [FEATURES.index(f) for f in policy[0]]
    x = np.array([[1.0, *(r[2 + i] for i in held)] for r in rows])
    penalty = np.diag([0.0] + [policy[1]] * len(held))
    b = np.linalg.pinv(x.T @ x + penalty) @ (x.T @ np.array([r[5] for r in rows]))
    return lambda r: b[0] + sum(v * r[2 + i] for v, i in zip(b[1:], held))


def plain(rows, chronological, least_rows, least_groups, tolerance):
    """Outer folds, inner folds and fits as the plain rule says, from rows."""
    rows, out = [r for r in rows if None not in r], {}
    fold = (lambda r: r[:2]) if chronological else (lambda r: (r[0], 0))
    for key, tests in groupby(sorted(rows, key=fold), key=fold):
        tests = list(tests)
        train = [r for r in rows if r[0] != key[0] and (not chronological or r[1] < key[1])]
        enough = lambda some: len(some) >= least_rows and len({r[0] for r in some}) >= least_groups
        if not enough(train):
            continue
        losses = {}
        for at, policy in enumerate(POLICIES):
            inner = []
            for h in sorted({r[0] for r in train}):
                left = [r for r in train if r[0] != h]
                if enough(left):
                    predict = fit(left, policy)
                    inner.append(np.mean([(predict(r) - r[5]) ** 2 for r in train if r[0] == h]))
            if inner:
                losses[at] = (np.mean(inner), len(inner))
        if losses:
            near = [at for at, (loss, _) in losses.items() if loss <= min(v for v, _ in losses.values()) + tolerance]
            at = min(near, key=lambda i: (-POLICIES[i][1], i))
            predict = fit(train, POLICIES[at])
            out[key] = (at, *losses[at], len(train), len(tests), np.mean([abs(predict(r) - r[5]) for r in tests]))
    return out


@pytest.mark.parametrize(("chronological", "least_rows", "least_groups", "tolerance"), [(False, 1, 2, 0.0), (True, 1, 2, 0.0), (True, 25, 3, 0.01), (False, 60, 4, 0.05)])
def test_outer_errors_equal_refitting(spark, rows, chronological, least_rows, least_groups, tolerance):
    table = spark.createDataFrame(rows, "g string, d int, a double, b double, c double, y double")
    got = nested_selection(table, "g", FEATURES, "y", POLICIES, "d" if chronological else None, least_rows, least_groups, tolerance).collect()
    expected = plain(rows, chronological, least_rows, least_groups, tolerance)
    found = {(r.g, r.d if chronological else 0): r for r in got}
    assert found.keys() == expected.keys() and len(expected) > 4
    for key, (policy, loss, groups, train, tests, error) in expected.items():
        r = found[key]
        assert (r.policy, r.inner_groups, r.train_rows, r.tests) == (policy, groups, train, tests)
        assert r.inner_loss == pytest.approx(loss, rel=1e-6, abs=1e-9) and r.mean_abs_error == pytest.approx(error, rel=1e-6, abs=1e-9)
    assert not chronological or len({r.policy for r in got}) > 1


def test_no_rows(spark):
    table = spark.createDataFrame([], "g string, d int, a double, b double, c double, y double")
    assert nested_selection(table, "g", FEATURES, "y", POLICIES).count() == 0
    assert nested_selection(table, "g", FEATURES, "y", POLICIES, "d").count() == 0
