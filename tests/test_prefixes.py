import random
import re
from datetime import date, timedelta
from statistics import median

import pytest

from tidemark.operators.panels import medians_of_others
from tidemark.operators.prefixes import prefix_medians, prefix_ranks

START = date(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, day date, v double")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    made = [(draw.choice("aab"), START + timedelta(draw.randrange(12)), float(draw.randrange(40)) if draw.random() < 0.7 else 7.0) for _ in range(700)]
    return made + [("a", None, 1.0), ("a", START, None), ("c", START, 2.0), ("d", START, -1.0), ("d", START + timedelta(400), -1.0)]


@pytest.mark.parametrize("slices", [None, 8, 64])
def test_ranks_against_all_pairs(spark, rows, slices):
    got = prefix_ranks(table(spark, rows), ["g"], "day", "v", slices)
    known = [r for r in rows if None not in r]
    expected = set()
    for g, day, v in set(known):
        before = [w for h, d, w in known if h == g and d < day]
        if before:
            expected.add((g, day, v, known.count((g, day, v)), len(before), round(sum(w <= v for w in before) / len(before), 9)))
    found = [(r.g, r.day, r.v, r.rows, r.earlier, round(r.share, 9)) for r in got.collect()]
    assert set(found) == expected and len(found) == len(expected)


@pytest.mark.parametrize("slices", [None, 8, 64])
def test_medians_against_all_pairs(spark, rows, slices):
    asked = [(g, START + timedelta(k)) for g in "abcde" for k in (0, 1, 5, 11, 300)]
    got = prefix_medians(table(spark, rows), spark.createDataFrame(asked + asked[:3], "g string, day date"), ["g"], "day", "v", slices)
    expected = {}
    for g, day in asked:
        before = [v for h, d, v in rows if h == g and d is not None and v is not None and d < day]
        if before:
            expected[g, day] = (median(before), len(before))
    found = got.collect()
    assert {(r.g, r.day): (r.median, r.n) for r in found} == expected and len(found) == len(expected)


def test_plan_has_no_join_of_ranges(spark, rows):
    for made in (prefix_ranks(table(spark, rows), ["g"], "day", "v"), prefix_medians(table(spark, rows), table(spark, rows), ["g"], "day", "v")):
        assert not re.search("Cartesian|NestedLoop", made._jdf.queryExecution().toString())


def test_empty_tables(spark):
    empty = table(spark, [])
    assert prefix_ranks(empty, ["g"], "day", "v").count() == 0
    assert prefix_medians(empty, empty, ["g"], "day", "v").count() == 0


@pytest.mark.parametrize("groups", [1, 2, 3, 6, 7])
def test_medians_of_others(spark, groups):
    draw = random.Random(groups)
    medians = [(f"g{k}", day, float(draw.randrange(5))) for k in range(groups) for day in (1, 2)]
    asked = [(f"g{k}", day) for k in range(groups + 1) for day in (1, 2, 3)]
    got = medians_of_others(spark.createDataFrame(medians, "g string, day int, median double"), spark.createDataFrame(asked, "g string, day int"), "g", "day")
    expected = {}
    for g, day in asked:
        others = [m for h, d, m in medians if d == day and h != g]
        if any(d == day for _, d, _ in medians):
            expected[g, day] = (median(others) if others else None, len(others))
    found = {(r.g, r.day): (r.others if r.groups else None, r.groups) for r in got.collect()}
    assert found == expected
