import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching as M
from tidemark.operators.pairing import best_similar, one_to_one, similar_pairs, window_match, window_pairs


def greedy(pairs):
    used, out = set(), set()
    for cost, a, b in sorted(pairs):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.add((a, b))
    return out


@pytest.mark.parametrize("costs", [4, 10_000])
def test_one_to_one_is_the_sequential_greedy(spark, costs):
    draw = random.Random(costs)
    pairs = [(draw.randrange(costs), draw.randrange(60), draw.randrange(60)) for _ in range(600)]
    got = one_to_one(spark.createDataFrame(pairs + pairs[:9], "cost int, a int, b int"), "a", "b", ["cost"]).collect()
    assert {(r.a, r.b) for r in got} == greedy(pairs) and len(got) == len(greedy(pairs))
    assert max(r.round for r in got) <= 12


def test_chains_take_rounds_and_odd_pairs(spark):
    chain = [(k, k // 2, (k + 1) // 2) for k in range(12)]
    got = one_to_one(spark.createDataFrame(chain, "cost int, a int, b int"), "a", "b", ["cost"]).collect()
    assert {(r.a, r.b) for r in got} == greedy(chain)
    odd = spark.createDataFrame([(None, 1, 1), (2, 1, 2), (3, None, 1), (4, 2, None)], "cost int, a int, b int")
    assert [(r.a, r.b) for r in one_to_one(odd, "a", "b", ["cost"]).collect()] == [(1, 1)]
    assert one_to_one(odd.where("false"), "a", "b", ["cost"]).count() == 0


def test_window_pairs_against_all_pairs(spark):
    draw, start = random.Random(3), date(2024, 1, 1)
    rows = lambda n: [(draw.randrange(2), start + timedelta(draw.randrange(200)), 10 ** draw.uniform(0, 1), k) for k in range(n)] + [(0, None, 1.0, -1), (0, start, None, -2), (0, start, -1.0, -3)]
    a, b = rows(90), rows(80)
    make = lambda r: spark.createDataFrame(r, "g int, day date, v double, k int")
    got = window_pairs(make(a), make(b), ["g"], "day", 20, "v", 0.8, 1.2)
    assert not re.search("Cartesian|NestedLoop", got._jdf.queryExecution().toString())
    fine = lambda x, y: None not in (x[1], x[2], y[1], y[2]) and min(x[2], y[2]) > 0 and x[0] == y[0] and abs((y[1] - x[1]).days) <= 20 and 0.8 <= y[2] / x[2] <= 1.2
    assert sorted((r.l_k, r.r_k) for r in got.collect()) == sorted((x[3], y[3]) for x in a for y in b if fine(x, y))


@pytest.mark.parametrize("near", [0.05, 100.0])
def test_window_match_is_the_greedy_over_all_pairs(spark, near):
    """Copies, ties between classes of unlike sizes, and single rows; in many tiers and in one. Rounds don't grow with copies."""
    draw, start = random.Random(7), date(2024, 1, 1)
    spots = [(draw.randrange(2), draw.randrange(0, 60, 10), draw.choice([1.0, 1.1, 1.21, 10 ** draw.uniform(0, 0.3)])) for _ in range(24)]
    rows = lambda base: [(g, start + timedelta(d), v, base + 7 * k + c * 1000) for k, (g, d, v) in enumerate(draw.sample(spots, 16)) for c in range(draw.randrange(1, 4))] + [(0, None, 1.0, -1), (0, start, -1.0, -3)]
    a, b = rows(1), rows(3)
    make = lambda r: spark.createDataFrame(r, "g int, day date, v double, k long")
    pairs = window_pairs(make(a), make(b), ["g"], "day", 20, "v", 0.8, 1.2).withColumns({"gap": F.round(F.abs(F.log("ratio")), 9), "away": F.abs("days_apart")}).collect()
    got = window_match(make(a), make(b), "k", ["g"], "day", 20, "v", 0.8, 1.2, near).collect()
    assert sorted((r.left, r.right) for r in got) == sorted(greedy([((r.gap, r.away), r.l_k, r.r_k) for r in pairs]))
    many = make([(0, start, 1.0, k) for k in range(3000)] + [(0, start, 1.1, 5000 + k) for k in range(100)])
    got = window_match(many, many, "k", ["g"], "day", 20, "v", 0.8, 1.2, near).collect()
    assert len(got) == 3100 and all(r.left == r.right for r in got) and max(r.round for r in got) == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("least", "q"), [(0.7, 3), (0.8, 3), (0.5, 2), (0.9, 2)])
def test_similar_pairs_against_all_pairs(spark, least, q):
    draw = random.Random(int(least * 100) + q)
    words = lambda n: ["".join(draw.choice("aabé ") for _ in range(draw.randrange(0, 14))) for _ in range(n)]
    a, b = words(70) + ["a" * 20, ""], words(70) + ["aaaabaaaaaaabaaaaaaa", "", "aaaab" * 4]
    make = lambda rows: spark.createDataFrame([(w,) for w in rows + [None, rows[0]]], "w string")
    got = similar_pairs(make(a), make(b), least, q)
    assert not re.search("Cartesian|NestedLoop", got._jdf.queryExecution().toString())
    expected = {(x, y) for x in a for y in b if 1 - distance(x, y) / max(len(x), len(y), 1) >= least - 1e-9}
    rows = got.collect()
    assert {(r.left, r.right) for r in rows} == expected and len(rows) == len(expected)
    assert all(r.similarity == pytest.approx(1 - distance(r.left, r.right) / max(len(r.left), len(r.right), 1)) for r in rows)


def test_a_low_similarity_needs_short_grams(spark):
    with pytest.raises(ValueError, match="smaller q"):
        similar_pairs(spark.createDataFrame([("a",)], "w string"), spark.createDataFrame([("a",)], "w string"), 0.5, 3)


def test_similar_names_come_after_exact_and_reviewed_ones(spark):
    left = spark.createDataFrame([(1, "harbour lights", "x"), (2, "harbor lights", "y"), (3, "quay watch", "z"), (4, "night watchman", "w"), (5, "nothing near", "v")], "l int, name string, block string")
    right = spark.createDataFrame([(10, "harbour lights", "x"), (11, "quay watchh", "q"), (12, "quay watchd", "q"), (13, "night watchmen", "q")], "r int, name string, block string")
    none = spark.createDataFrame([], "l int, r int")
    got = {r.l: (r.r, r.method) for r in M.audited_match(left, right, "l", "r", "name", "block", none, none.select("l"), least=0.8).collect()}
    assert got == {1: (10, "exact name"), 2: (10, "similar name"), 3: (None, "ambiguous similar name"), 4: (13, "similar name"), 5: (None, "unmatched")}
    assert best_similar(left.select("name"), right.select("name"), 0.8).where(F.col("as_good") > 1).count() == 1
