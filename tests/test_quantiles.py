import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A

LEVELS = {"low": 0.0, "a": 0.1, "middle": 0.5, "b": 0.8, "c": 0.999, "high": 1.0}


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles_are_exact_for_small_and_large_keys(spark, monkeypatch, accuracy):
    """With a coarse sketch the brackets of large keys hold few values, and still the right ones."""
    monkeypatch.setattr(A, "ACCURACY", accuracy)
    draw = random.Random(accuracy)
    values = {k: [draw.gauss(0, 1) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 7), ("d", 3000), (None, 500))}
    values["e"] = [float(draw.randrange(3)) for _ in range(2500)]
    values["f"] = [1.0] * 1999 + [2.0]
    rows = [(k, v) for k, held in values.items() for v in held] + [("a", None)]
    draw.shuffle(rows)
    got = {r.k: r for r in A.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", LEVELS).collect()}
    assert got.keys() == values.keys()
    for k, held in values.items():
        for name, q in LEVELS.items():
            assert got[k][name] == pytest.approx(np.quantile(held, q), rel=1e-12, abs=1e-12), (k, name)
    whole = A.quantiles(spark.createDataFrame(rows, "k string, v double"), [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median([v for held in values.values() for v in held]))


def test_few_values_of_a_large_key_are_sorted(spark):
    rows = spark.range(400_000).select((F.col("id") % 2).alias("k"), F.hash("id").cast("double").alias("v"))
    made = A.quantiles(rows, ["k"], "v", {"m": 0.5})
    values = rows.where("k = 0").toPandas().v
    assert {r.k: r.m for r in made.collect()}[0] == np.median(values)


def test_deviations(spark):
    rows = spark.createDataFrame([(k, float(v)) for k, held in ((1, [1, 2, 9, 9, 30]), (2, [4, 4]), (None, [1, 5])) for v in held], "k int, v double")
    got = {r.k: (r.centre, r.deviation) for r in A.absolute_deviation(rows, ["k"], "v").collect()}
    assert got == {1: (9.0, 7.0), 2: (4.0, 0.0), None: (3.0, 2.0)}
    assert A.quantiles(rows.where("false"), ["k"], "v", {"m": 0.5}).count() == 0


def test_size_medians_are_exact(spark):
    """Keys of one, two and many values, zeros, ties, a null key and values that share a bucket."""
    draw = random.Random(8)
    values = {"a": [3.0], "b": [0.0, 2.0], "c": [0.0] * 5 + [1.0] * 2, "d": [abs(draw.gauss(0, 1)) for _ in range(3001)], None: [10 ** draw.uniform(-9, 9) for _ in range(400)], "e": [5.0 + k * 1e-9 for k in range(50)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(5)
    for cells in (1, 2048):
        assert {r.k: r.m for r in A.size_medians(df, ["k"], "v", "m", cells).collect()} == {k: float(np.median(vs)) for k, vs in values.items()}
    assert A.size_medians(df.limit(0), ["k"], "v", "m").count() == 0
    assert A.size_medians(df.where("k = 'd'"), [], "v", "m").first().m == float(np.median(values["d"]))


def test_unfolded_rows_are_not_broadcast(spark, tmp_path):
    """A small table unfolded many times looks small to Spark; with few keys it is the brackets that are broadcast."""
    spark.range(1000).selectExpr("id * 1.0D AS v").write.parquet(str(tmp_path / "rows"))
    unfolded = spark.read.parquet(str(tmp_path / "rows")).select("v", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    got = A.quantiles(unfolded, ["k"], "v", {"m": 0.5}, few=True)
    assert "BuildRight" in got._jdf.queryExecution().executedPlan().toString() and "BuildLeft" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.m for r in got.collect()} == {k: 499.5 for k in range(10)}
