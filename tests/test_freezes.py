from pyspark.sql import functions as F

from tidemark.operators.freezes import changed_ranges, digest_tree, row_digests, verify_freeze


def test_changes_are_named_by_range_and_row(spark):
    df = spark.range(2000).select(F.when(F.col("id") != 77, F.col("id")).alias("k"), (F.col("id") % 5).alias("v"), F.lit(None).cast("string").alias("n"))
    df = df.unionByName(df.where("k = 5"))
    frozen = row_digests(df, ["k"])
    tree = digest_tree(frozen)
    assert changed_ranges(tree, digest_tree(row_digests(df.repartition(7), ["k"]))).count() == 0
    assert {r.level: r.n for r in tree.groupBy("level").agg(F.sum("rows").alias("n")).collect()} == {0: 2001, 1: 2001, 2: 2001}
    now = df.where("k is null or k <> 40").withColumn("v", F.when(F.col("k") == 41, -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(9999, 1, None)], df.schema))
    now = now.dropDuplicates().withColumn("n", F.when(F.col("k").isNull(), "set").otherwise(F.col("n")))
    got = {r.k: (r.change, r.range) for r in verify_freeze(frozen, now, ["k"]).collect()}
    assert {k: c for k, (c, _) in got.items()} == {40: "removed", 41: "changed", 9999: "added", None: "changed", 5: "changed"}
    ranges = changed_ranges(tree, digest_tree(row_digests(now, ["k"]))).collect()
    assert {r.range for r in ranges if r.level == 2} == {r for _, r in got.values()}
    assert [(r.frozen_rows, r.rows) for r in ranges if r.level == 0] == [(2001, 2000)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, v long")
    assert digest_tree(row_digests(none, ["k"])).where("rows > 0").count() == 0
    assert [r.change for r in verify_freeze(row_digests(none, ["k"]), spark.createDataFrame([(1, 2)], none.schema), ["k"]).collect()] == ["added"]
