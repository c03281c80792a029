import re

import pytest
from pyspark.sql import functions as F

from tidemark.plans.resampling import POISSON, cluster_bootstrap, drawn, numbered, poisson_bootstrap, poisson_sums, poisson_weight
from tidemark.registry import orders_panel


@pytest.mark.parametrize("by_row", [False, True])
def test_the_interval_is_that_of_numbered_clusters(spark, small, by_row):
    rows = orders_panel(spark, small)
    a = cluster_bootstrap(rows, "o_custkey", "y", 300, 5, by_row).first()
    b = poisson_bootstrap(rows, ["o_custkey"], "y", 300, 5, by_row).first()
    assert b.observed == pytest.approx(a.observed, rel=1e-12) and b.clusters == a.clusters and b.defined == 300
    width = a.high - a.low
    assert abs(b.low - a.low) < 0.2 * width and abs(b.high - a.high) < 0.2 * width
    assert b.low == pytest.approx(a.low, rel=0.02) and b.high == pytest.approx(a.high, rel=0.02)


def test_no_task_holds_all_clusters(spark, small):
    plan = poisson_bootstrap(orders_panel(spark, small), ["o_custkey"], "y", 50, 5)._jdf.queryExecution().toString()
    assert not re.search("Window", plan)


def test_numbers_are_poisson(spark):
    got = spark.range(40_000).select(poisson_weight(F.lit(1), F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).first()
    assert got.m == pytest.approx(1, abs=0.02) and got.v == pytest.approx(1, abs=0.04) and got.z == pytest.approx(0.3679, abs=0.01)
    assert POISSON[-1] <= 1 << 32 and list(POISSON) == sorted(POISSON)


def test_whole_outer_clusters_are_drawn(spark):
    """Inner clusters of one outer cluster vary together, so the interval is wider than that of as many loose clusters."""
    rows = spark.range(2000).select((F.col("id") % 20).alias("o"), F.col("id").alias("i"), (F.col("id") % 20 + F.rand(3)).alias("v"))
    loose, nested = poisson_bootstrap(rows, ["i"], "v", 200, 1).first(), poisson_bootstrap(rows, ["i"], "v", 200, 1, outer=["o"]).first()
    assert nested.high - nested.low > 2 * (loose.high - loose.low)


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_are_those_of_a_sorted_list(spark, parts):
    """A key that holds most rows, null keys and values, words as order, and no rows at all."""
    rows = [("hot" if i % 5 else None if i % 2 else f"k{i % 3}", f"r{i * 7919 % 1000:04d}" if i != 50 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, r string").repartition(parts)
    place = lambda v: (v is not None, v or "")
    for within in ([], ["k"]):
        groups = {}
        for k, r in rows:
            groups.setdefault(k if within else "", []).append((k, r))
        expected = sorted(((k, r, n, len(g)) for g in groups.values() for n, (k, r) in enumerate(sorted(g, key=lambda x: place(x[1])))), key=repr)
        assert sorted((tuple(x) for x in numbered(df, within, "r").select("k", "r", "_k", "_m").collect()), key=repr) == expected
    assert numbered(df.limit(0), ["k"], "r").count() == 0


def test_a_draw_has_as_many_slots_as_cells(spark):
    cells = numbered(spark.range(11).withColumnRenamed("id", "c"), [], "c")
    got = drawn(cells, 4, 3).groupBy("draw").agg(F.count_distinct("slot").alias("n"), F.min("_k").alias("low"), F.max("_k").alias("high")).collect()
    assert len(got) == 4 and all(r.n == 11 and 0 <= r.low <= r.high < 11 for r in got)


def test_draws_are_dealt_and_digests_taken_once(spark):
    """Few bytes of clusters are dealt over all tasks, and no filter repeats the digests; draws of nothing give no row."""
    cells = spark.range(300).select((F.col("id") % 40).alias("o"), F.col("id").alias("i"), F.lit(1.0).alias("s")).groupBy("o", "i").agg(F.sum("s").alias("s"))
    got = poisson_sums(cells, [["o"], ["o", "i"]], [], {"s": F.col("s")}, 30, 3)
    plan = got._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("md5(") == 2 and re.search(r"xxhash64\(.*REPARTITION_BY_NUM", plan.toString())
    weights = cells.select("s", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("draw"), "o", "i").select("draw", (poisson_weight(F.lit(3), F.col("draw"), F.col("o")) * poisson_weight(F.lit(4), F.col("draw"), F.col("o"), F.col("i"))).alias("w"))
    assert {r.draw: r.s for r in got.collect()} == {r.draw: r.s for r in weights.groupBy("draw").agg(F.sum("w").cast("double").alias("s")).collect()}
    one = poisson_sums(cells.limit(1), [["o"]], [], {"s": F.col("s")}, 200, 3).collect()
    assert 90 < len(one) < 160 and all(r.s > 0 for r in one)
