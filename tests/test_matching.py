import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching as M


def test_unique_join_fails_on_a_repeated_key(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="not unique"):
        M.unique_join(left, right, ["k"]).collect()
    assert M.unique_join(left, right.where("v = 'a'"), ["k"], "left").count() == 2


def test_stale_override_fails(spark):
    base = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    good = spark.createDataFrame([(2, None, "new")], "k long, expected string, replacement string")
    assert {r.k: r.v for r in M.apply_overrides(base, good, "k", "v").collect()} == {1: "x", 2: "new"}
    with pytest.raises(Exception, match="expects another value"):
        M.apply_overrides(base, spark.createDataFrame([(1, "old", "new")], good.schema), "k", "v").collect()


def test_skyline_with_ties_and_few_rows(spark):
    rows = [(1, 5.0), (1, 5.0), (2, 5.0), (2, 6.0), (3, 6.0), (3, 1.0)]
    got = sorted(map(tuple, M.skyline(spark.createDataFrame(rows, "a int, b double"), "a", "b").collect()))
    assert got == [(1, 5.0), (1, 5.0), (2, 6.0)]
    assert M.skyline(spark.createDataFrame([], "a int, b double"), "a", "b").count() == 0


def test_any_present(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 1, None)], "k int, a int, b int")
    assert [r.k for r in M.any_present(rows, ["a", "b"]).collect()] == [2]
    assert M.same_rows(rows, rows).count() == 0 and M.same_rows(rows, rows.where(F.col("k") == 1)).count() == 1


def test_ratio_match_pairs_distinct_sizes_and_names(spark):
    """Copies meet as one; the best of all pairs is found whatever is null, repeated or tied."""
    draw = random.Random(5)
    name = lambda: "".join(draw.choice("abc") for _ in range(draw.randrange(0, 6)))
    rows = lambda n: [(k, 10 ** draw.uniform(0, 0.5), name()) for k in range(n)] + [(n, None, "abc"), (n + 1, 2.0, None), (n + 2, -1.0, "abc"), (n + 3, 0.0, "abc")]
    left, right = rows(60), rows(50)
    left, right = left + [(k + 100, s, t) for k, s, t in left], right + [(k + 200, s, t) for k, s, t in right] * 2
    make = lambda r: spark.createDataFrame(r, "k long, s double, t string")
    make_right = make(right).withColumnRenamed("k", "j")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    expected = {}
    for k, s, t in left:
        fine = [(-(1 - edits(t, u) / max(len(t), len(u), 1)), round(max(s / z, z / s), 9), j) for j, z, u in right if None not in (s, t, z, u) and s > 0 and z > 0 and max(s / z, z / s) <= 1.1]
        if fine and min(fine)[0] <= -0.5:
            expected[k] = (min(fine)[2], -min(fine)[0])
    got = M.ratio_match(make(left), make_right, "k", "j", "s", "t", 1.1, 0.5).collect()
    assert {r.k: (r.j, r.similarity) for r in got} == expected
    same = lambda c: spark.range(3000).select(F.col("id").alias(c), F.lit(5.0).alias("s"), F.lit("name").alias("t"))
    assert M.ratio_candidates(same("k"), same("j"), "j", "s", "t", 1.1).count() == 1
    assert M.ratio_match(same("k"), same("j"), "k", "j", "s", "t", 1.1, 0.5).where("j = 0 and similarity = 1").count() == 3000


def most_rows(df):
    """The most rows that a step of the finished plan put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            todo.append(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
            continue
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_ratio_match_lists_no_pairs(spark):
    """400 distinct names of one size on each side are 160,000 pairs; no step puts out more than rows and the buckets they are offered to."""
    side = lambda c, word: spark.range(400).select(F.col("id").alias(c), F.lit(5.0).alias("s"), F.concat(F.lit(word), F.col("id").cast("string")).alias("t"))
    got = M.ratio_match(side("k", "left"), side("j", "lift"), "k", "j", "s", "t", 1.05, 0.5)
    assert most_rows(got) <= 10 * 400
    assert {(r.k, r.j, round(r.similarity, 9)) for r in got.collect()} == {(k, k, round(1 - 1 / (4 + len(str(k))), 9)) for k in range(400)}


@pytest.mark.parametrize("ratio,state", [(1.05, 1 << 26), (1.0, 1 << 26), (3.0, 1)])
def test_ratio_match_in_small_blocks_with_odd_rows(spark, monkeypatch, ratio, state):
    """Many blocks and tiles give the best of all pairs: names of any length and script, sizes of any scale, null ids, ties."""
    from tests.test_pairing import distance
    from tidemark.operators import likeness

    draw = random.Random(7)
    name = lambda: "".join(draw.choice("ab\0é𝄞") for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 300 if draw.random() < 0.03 else 4])))
    size = lambda: draw.choice([2.0, 2.0 * 1.05, 2.1, 1e-300, 1e300, float("inf"), float("nan"), None, -1.0, 0.0, round(draw.uniform(1, 4), 2)])
    left, right = [(k, size(), name()) for k in range(150)], [(j if j else None, size(), name()) for j in range(150)]
    first = lambda j: (j is not None, j or 0)
    expected = {}
    for k, s, t in left:
        fine = [
            (-(1 - distance(t, u) / max(len(t), len(u), 1)), round(max(s / z, z / s), 9), first(j))
            for j, z, u in right
            if None not in (s, z) and 0 < s < float("inf") and 0 < z < float("inf") and max(s / z, z / s) <= ratio
        ]
        if fine and min(fine)[0] <= -0.5:
            expected[k] = (min(fine)[2], -min(fine)[0])
    make = lambda rows, c: spark.createDataFrame(rows, f"{c} long, s double, t string")
    got = M.ratio_match(make(left, "k"), make(right, "j"), "k", "j", "s", "t", ratio, 0.5, block=7).collect()
    assert {r.k: (first(r.j), r.similarity) for r in got} == expected and len(expected) > 20
    monkeypatch.setattr(likeness, "STATE_BYTES", state)
    monkeypatch.setattr(likeness, "LETTERS", 2)
    import pyarrow as pa
    from pyspark.sql import types as T

    fine = lambda rows: [(k, s, t) for k, s, t in rows if s is not None and 0 < s < float("inf")]
    lefts, rights = fine(left), fine(right)
    schema = T.StructType([T.StructField("_ls", T.DoubleType()), T.StructField("_ln", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("g", T.DoubleType()), T.StructField("r", T.LongType())])
    column = lambda rows, i, t: pa.array([r[i] for r in rows], t)
    whole = likeness.most_similar(ratio, 0.5, schema)(
        pa.table({"_ls": column(lefts, 1, pa.float64()), "_ln": column(lefts, 2, pa.string())}),
        pa.table({"_rs": column(rights, 1, pa.float64()), "_rn": column(rights, 2, pa.string()), "_r": pa.StructArray.from_arrays([column(rights, 0, pa.int64())], names=["j"])}),
    )
    by_row = {(r["_ls"], r["_ln"]): (first(r["r"]), -r["s"]) for r in whole.to_pylist()}
    assert {k: by_row[s, t] for k, s, t in lefts if (s, t) in by_row} == expected


def test_halves_round_as_in_spark(spark):
    """Gaps whose decimal text ends in a half at the tenth place."""
    import numpy as np

    from tidemark.operators.likeness import _rounded

    draw = random.Random(3)
    gaps = [float(f"1.{draw.randrange(10**8):09d}5") for _ in range(2000)] + [draw.uniform(1, 1.05) for _ in range(2000)] + [1.0, 1e7 + 0.1234567895, 3e12]
    want = [r.g for r in spark.createDataFrame([(g,) for g in gaps], "g double").select(F.round("g", 9).alias("g")).collect()]
    assert _rounded(np.array(gaps)).tolist() == want
