import math
import random
import re
import statistics
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import shaping
from tidemark.plans import linear, regression


def test_walk_forward_never_sees_its_group_or_its_day(spark):
    rng = random.Random(2)
    rows = [(g, d, float(d), 2.0 + 0.5 * d + rng.gauss(0, 1)) for g in "abc" for d in range(12) for _ in range(rng.randint(0, 3))]
    got = {(r.g, r.d, r.y): r for r in regression.walk_forward(spark.createDataFrame(rows, "g string, d int, x double, y double"), "g", "d", "x", "y", 5).collect()}
    for g, d, x, y in rows:
        past = [(a, b) for h, e, a, b in rows if h != g and e < d]
        if len(past) < 5 or len({a for a, _ in past}) < 2:
            assert (g, d, y) not in got
            continue
        slope, intercept = statistics.linear_regression(*zip(*past))
        assert got[g, d, y].predicted == pytest.approx(intercept + slope * x, rel=1e-6) and got[g, d, y].train_rows == len(past)


def test_huber_resists_outliers(spark):
    rng = random.Random(4)
    rows = [("a", float(x), 3.0 + 2.0 * x + rng.gauss(0, 0.1)) for x in range(100)] + [("a", 50.0, 9000.0)] * 5 + [("a", None, 1.0)]
    fit = linear.huber_fit(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x"], "y").first()
    assert fit.n == 105 and fit.b1 == pytest.approx(2.0, abs=0.02) and fit.b0 == pytest.approx(3.0, abs=0.5)


def test_student_t_by_table(spark):
    rows = spark.createDataFrame([(12.706204736, 1.0), (2.228138852, 10.0), (0.0, 5.0), (1.0, -1.0)], "t double, n double")
    p = [r[0] for r in rows.select(S.student_t_p("t", "n")).collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-8) and p[1] == pytest.approx(0.05, abs=1e-8) and p[2] == pytest.approx(1.0) and (p[3] is None or math.isnan(p[3]))


def test_similarity(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), (None, None), ("a", None)], "a string, b string")
    assert [r[0] for r in rows.select(S.similarity_ratio("a", "b")).collect()] == [0.75, 1.0, 0.0]


def test_strict_boolean_fails_on_other_words(spark):
    assert [r[0] for r in spark.createDataFrame([("True",), ("False",)], "a string").select(S.strict_boolean(F.col("a"))).collect()] == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("yes",)], "a string").select(S.strict_boolean(F.col("a"))).collect()


def test_urls_paths_pointers(spark):
    row = spark.createDataFrame([("HTTPS://Hub.example/Org/Model/tree/main/?x=1", "/home/jo/file", "a/b~c")], "u string, p string, k string").select(
        S.normal_url(F.col("u")), S.scrub_paths(F.col("p")), S.json_pointer(F.lit("x"), F.col("k"))
    ).first()
    assert tuple(row) == ("https://hub.example/org/model", "/home/_/file", "/x/a~1b~0c")


def test_keys_are_decomposed(spark):
    """Each character beyond ASCII that decomposes to letters or digits, and some that don't, against the standard library."""
    odd = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    texts = [*odd, "Straße Œuvre", "ﬁ½㎏ Ⅷ ⑩ Ａｂ", "naïve — Ünder 7", "", "plain 12"]
    got = spark.createDataFrame([(t, t.lower()) for t in texts], "a string, low string").select("a", S.compatible_letters(F.col("low")).alias("c")).collect()
    letters = lambda t: re.sub("[^a-z0-9]", "", t)
    for row in got:
        assert letters(row.c) == letters(unicodedata.normalize("NFKD", row.a.lower())), row.a
    keys = spark.createDataFrame([("Ünder-Straße ½ (Thinking)",), (None,)], "a string").select(S.normal_key(F.col("a"), ("thinking",))).collect()
    assert [k[0] for k in keys] == ["understrae12", None]


def test_ascii_texts_meet_no_table(spark):
    """The table is met by distinct characters beyond ASCII only, and its patterns are ranges."""
    assert len(S._ranges([chr(c) for c in range(0x2460, 0x2474)])) < 20
    texts = ["plain text " * 2000, "é½ﬁ x" * 3000 + "éé", "中文 only", ""]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select("a", S.normal_key(F.col("a")).alias("k"))
    assert "octet_length" in df._jdf.queryExecution().optimizedPlan().toString()
    for row in df.collect():
        assert row.k == re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", row.a.lower()))


def test_predicates_and_identities(spark):
    rows = spark.createDataFrame([("An Éclair 42",), ("eclair",), (None,)], "a string")
    one = F.col("a")
    tests = rows.select(S.accepted(one), S.accepted(one, ("eclair",)), S.accepted(one, contains=("éCLAIR", "x")), S.accepted(one, contains=("clair",), pattern=r"\d+$")).collect()
    assert [tuple(t) for t in tests] == [(True, False, True, True), (True, True, False, False), (False,) * 4]
    people = spark.sql("SELECT array(struct('Jo' AS name, 3 AS n), struct(NULL AS name, 4 AS n)) AS r, 'in /srv/jo/app/x, /srv/jo/y, /srv/joan/z' AS p")
    row = people.select(S.without_identities(F.col("r"), ("name",)), S.portable_paths(F.col("p"), "/srv/jo/app", "/srv/jo/")).first()
    assert [tuple(x) for x in row[0]] == [("<name>", 3), ("<name>", 4)] and row[1] == "in ./x, ~/y, /srv/joan/z"


def test_contracts_fail_the_load(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert shaping.require_contract(rows, ["k", "v"], ["k"], 2) is rows
    assert shaping.require_contract(rows.limit(0), ["k", "v"], ["k"], 0).count() == 0
    repeated, blank = rows.unionByName(rows.limit(1)), rows.withColumn("k", F.nullif("k", F.lit(2)))
    for df, header, count, words in ((rows, ["v", "k"], None, "columns are"), (rows, ["k", "v"], 3, "2 of 3 rows"), (repeated, ["k", "v"], None, "1 repeated"), (blank, ["k", "v"], None, "1 with a null"), (rows.limit(0), ["k", "v"], 1, "0 of 1")):
        with pytest.raises(ValueError, match=words):
            shaping.require_contract(df, header, ["k"], count)


def test_huber_with_several_features(spark):
    rng = random.Random(6)
    rows = [("a", float(x), float(x * x % 17), 3.0 + 2.0 * x - 0.5 * (x * x % 17) + rng.gauss(0, 0.1)) for x in range(120)] + [("a", 60.0, 3.0, 9000.0)] * 6
    fit = linear.huber_fit(spark.createDataFrame(rows, "g string, x double, z double, y double"), ["g"], ["x", "z"], "y").first()
    assert fit.n == 126 and fit.b1 == pytest.approx(2.0, abs=0.02) and fit.b2 == pytest.approx(-0.5, abs=0.03)


def test_dependent_features_get_the_least_coefficients(spark):
    rows = [(float(x), 2.0 * x, 1.0 + 5.0 * x) for x in range(20)]
    fit = linear.weighted_fit(spark.createDataFrame(rows, "x double, z double, y double").selectExpr("'a' AS g", "*"), ["g"], ["x", "z"], "y").first()
    assert (fit.b0, fit.b1, fit.b2) == pytest.approx((1.0, 1.0, 2.0), abs=1e-6)


def test_walk_forward_with_equal_groups(spark):
    rng = random.Random(3)
    rows = [(g, d, float(d), float(rng.randint(0, 4)), 0.0) for g in "abcd" for d in range(10) for _ in range(rng.randint(0, 4))]
    rows = [(g, d, x, z, 2.0 + 0.5 * x - 0.3 * z + rng.gauss(0, 1)) for g, d, x, z, _ in rows]
    df = spark.createDataFrame(rows, "g string, d int, x double, z double, y double")
    got = {(r.g, r.d, r.y): r.predicted for r in linear.walk_forward(df, "g", "d", ["x", "z"], "y", 6, 2, ridge=1.0).collect()}
    seen = 0
    for g, d, x, z, y in rows:
        past = [r for r in rows if r[0] != g and r[1] < d]
        groups = {r[0] for r in past}
        if len(past) < 6 or len(groups) < 2:
            assert (g, d, y) not in got
            continue
        w = np.array([1 / sum(r[0] == p[0] for r in past) for p in past])
        w *= len(past) / w.sum()
        a = np.array([[1.0, p[2], p[3]] for p in past])
        b = np.linalg.solve(a.T @ (a * w[:, None]) + np.diag([0.0, 1.0, 1.0]), a.T @ (w * np.array([p[4] for p in past])))
        assert got[g, d, y] == pytest.approx(float(b @ [1.0, x, z]), rel=1e-6)
        seen += 1
    assert seen > 20
