"""Queries of fits, weight choices, intervals and comparisons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import windows as W
from tidemark.plans import evaluation as E
from tidemark.plans import linear as L
from tidemark.plans import resampling
from tidemark.registry import ORDERS, orders_panel, query, rounded
from tidemark.sources import tables as T

_DRAW = "CAST('0x' || substr(md5({parts}), 1, 8) AS UBIGINT)"


def _draw(*parts: str) -> str:
    return _DRAW.format(parts=" || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))


def _monthly(spark, folder):
    """Orders with the month as their day, a second feature, and the row's own weight."""
    rows = orders_panel(spark, folder).withColumn("day", F.trunc("o_orderdate", "month")).withColumn("p", F.substring("o_orderpriority", 1, 1).cast("double"))
    return rows.withColumn("w", 1.0 + F.col("o_custkey") % 3)


_MONTHLY = f"""{ORDERS}, m AS (SELECT nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, x, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS p, y, 1.0 + o_custkey % 3 AS w, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders_by_nation)"""
_CENTRED = """sxx - sx * sx / s AS xx, spp - sp * sp / s AS pp, sxp - sx * sp / s AS xp, sxy - sx * sy / s AS xy, spy - sp * sy / s AS py"""


# ---------------------------------------------------------------- fits


@query(f"""WITH {_MONTHLY}, c AS (SELECT nation, day, count(*) AS n, sum(x) AS x, sum(p) AS p, sum(y) AS y, sum(x * x) AS xx, sum(p * p) AS pp, sum(x * p) AS xp, sum(x * y) AS xy, sum(p * y) AS py FROM m GROUP BY 1, 2),
g AS (SELECT t.nation, t.day, c.nation AS g, sum(c.n) AS n, sum(c.x) AS x, sum(c.p) AS p, sum(c.y) AS y, sum(c.xx) AS xx, sum(c.pp) AS pp, sum(c.xp) AS xp, sum(c.xy) AS xy, sum(c.py) AS py
 FROM c AS t JOIN c ON c.day < t.day AND c.nation <> t.nation GROUP BY 1, 2, 3),
a AS (SELECT nation, day, sum(n) AS rows, count(*) AS s, sum(x / n) AS sx, sum(p / n) AS sp, sum(y / n) AS sy, sum(xx / n) AS sxx, sum(pp / n) AS spp, sum(xp / n) AS sxp, sum(xy / n) AS sxy, sum(py / n) AS spy FROM g GROUP BY 1, 2 HAVING sum(n) >= 100 AND count(*) >= 5),
d AS (SELECT *, {_CENTRED}, 2.0 * s / rows AS r FROM a), b AS (SELECT *, (xy * (pp + r) - py * xp) / ((xx + r) * (pp + r) - xp * xp) AS b1, (py * (xx + r) - xy * xp) / ((xx + r) * (pp + r) - xp * xp) AS b2 FROM d)
SELECT m.nation, count(*) AS tests, round(avg(abs((sy - b1 * sx - b2 * sp) / s + b1 * m.x + b2 * m.p - m.y)), 6) AS mean_abs_error FROM m JOIN b USING (nation, day) GROUP BY 1""")
def walkforward_wls(spark, folder):
    tests = L.walk_forward(_monthly(spark, folder), "nation", "day", ["x", "p"], "y", 100, 5, ridge=2.0)
    return rounded(tests.groupBy("nation").agg(F.count(F.lit(1)).alias("tests"), F.avg(F.abs("error")).alias("mean_abs_error")), "mean_abs_error")


@query(f"""WITH {_MONTHLY}, a AS (SELECT nation, count(*) AS n, sum(w) AS s, sum(w * x) AS sx, sum(w * p) AS sp, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * p * p) AS spp, sum(w * x * p) AS sxp, sum(w * x * y) AS sxy, sum(w * p * y) AS spy FROM m GROUP BY 1),
d AS (SELECT *, {_CENTRED} FROM a), b AS (SELECT *, (xy * pp - py * xp) / (xx * pp - xp * xp) AS b1, (py * xx - xy * xp) / (xx * pp - xp * xp) AS b2 FROM d)
SELECT nation, n, round((sy - b1 * sx - b2 * sp) / s, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM b""")
def weighted_least_squares(spark, folder):
    return rounded(L.weighted_fit(_monthly(spark, folder), ["nation"], ["x", "p"], "y", "w"), "b0", "b1", "b2")


@query(f"""WITH {_MONTHLY}, a AS (SELECT nation, count(*) AS n, count(*) AS s, sum(x) AS sx, sum(p) AS sp, sum(y) AS sy, sum(x * x) AS sxx, sum(p * p) AS spp, sum(x * p) AS sxp, sum(x * y) AS sxy, sum(p * y) AS spy FROM m GROUP BY 1),
d AS (SELECT *, {_CENTRED} FROM a), b AS (SELECT *, (xy * (pp + 5) - py * xp) / ((xx + 5) * (pp + 5) - xp * xp) AS b1, (py * (xx + 5) - xy * xp) / ((xx + 5) * (pp + 5) - xp * xp) AS b2 FROM d)
SELECT nation, n, round((sy - b1 * sx - b2 * sp) / s, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM b""")
def ridge_fit(spark, folder):
    return rounded(L.weighted_fit(_monthly(spark, folder), ["nation"], ["x", "p"], "y", ridge=5.0), "b0", "b1", "b2")


@query("""WITH f AS (SELECT t.c_custkey, regr_slope(o.c_acctbal, o.c_custkey) AS slope, regr_intercept(o.c_acctbal, o.c_custkey) AS intercept FROM customer t JOIN customer o ON o.c_nationkey = t.c_nationkey AND o.c_custkey <> t.c_custkey GROUP BY 1 HAVING count(*) > 1)
SELECT c_custkey, round(slope, 5) AS slope, round(intercept + slope * c_custkey, 4) AS predicted FROM customer LEFT JOIN f USING (c_custkey)""")
def loo_regression(spark, folder):
    customers = T.table(spark, folder, "customer").withColumn("key", F.col("c_custkey").cast("double"))
    out = L.leave_one_row_out(customers, ["c_nationkey"], "key", "c_acctbal")
    return out.select("c_custkey", F.round("slope", 5).alias("slope"), F.round("predicted", 4).alias("predicted"))


@query(f"""WITH {_MONTHLY}, a AS (SELECT nation, regr_slope(y, p) AS slope, regr_intercept(y, p) AS intercept, count(*) AS n FROM m GROUP BY 1), r AS (SELECT m.nation, x, y - a.intercept - a.slope * p AS e FROM m JOIN a USING (nation)),
b AS (SELECT nation, regr_slope(e, x) AS date_slope, regr_intercept(e, x) AS date_intercept FROM r GROUP BY 1) SELECT nation, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(date_slope, 6) AS date_slope, round(date_intercept, 6) AS date_intercept FROM a JOIN b USING (nation)""")
def two_stage_regression(spark, folder):
    return rounded(L.two_stage(_monthly(spark, folder), ["nation"], "p", "y", "x"), "slope", "intercept", "date_slope", "date_intercept")


@query(f"""WITH {_MONTHLY}, b AS (SELECT nation, avg(y) AS base FROM m GROUP BY 1), s AS (SELECT nation, CAST(p AS INTEGER) AS part, count(*) AS n, sum(x * x) AS zz, sum(x * (y - base)) AS zr FROM m JOIN b USING (nation) GROUP BY 1, 2),
t AS (SELECT *, 3.0 * max(n) OVER (PARTITION BY nation) / n AS penalty FROM s) SELECT nation, part, n, round(penalty, 6) AS penalty, round(zr / (zz + penalty) * n / (n + 2), 6) AS coefficient FROM t""")
def residual_ridge_by_part(spark, folder):
    rows = _monthly(spark, folder).withColumn("part", F.col("p").cast("int"))
    based = rows.join(rows.groupBy("nation").agg(F.avg("y").alias("base")), "nation").withColumn("left", F.col("y") - F.col("base"))
    return rounded(L.residual_ridge(based, ["nation"], "part", "x", "left", 3.0), "penalty", "coefficient")


@query("""WITH k AS (SELECT quantile_cont(p_size, 0.25) AS a, quantile_cont(p_size, 0.5) AS b, quantile_cont(p_size, 0.75) AS c FROM part WHERE p_partkey % 3 <> 0)
SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS square, round(p_size * p_retailprice, 4) AS interaction, greatest(0.0, p_size - a) AS hinge_1, greatest(0.0, p_size - b) AS hinge_2, greatest(0.0, p_size - c) AS hinge_3 FROM part, k""")
def feature_bases(spark, folder):
    parts = T.table(spark, folder, "part").withColumn("p_size", F.col("p_size").cast("double"))
    out = L.feature_bases(parts, F.col("p_partkey") % 3 != 0, "p_size", "p_retailprice")
    return rounded(out.select("p_partkey", "square", "interaction", "hinge_1", "hinge_2", "hinge_3"), "interaction", digits=4)


@query("""WITH v AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS v FROM part), c AS (SELECT p_brand, median(v) AS m, stddev_pop(v) AS d FROM v GROUP BY 1),
s AS (SELECT p_brand, any_value(m) AS m, any_value(d) AS d, 1.4826 * median(abs(v - m)) AS mad FROM v JOIN c USING (p_brand) GROUP BY 1)
SELECT p_partkey, round(coalesce(greatest(-1.5, least(1.5, (v - m) / CASE WHEN mad >= 1e-6 THEN mad WHEN d >= 1e-6 THEN d ELSE 1 END)), 0), 6) AS z FROM v LEFT JOIN s USING (p_brand)""")
def standardised_features(spark, folder):
    parts = T.table(spark, folder, "part").withColumn("v", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")))
    return rounded(L.standardised(parts, ["p_brand"], "v", 1.5).select("p_partkey", "z"), "z")


@query(f"""WITH {_MONTHLY}, c AS (SELECT nation, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM m GROUP BY 1), t AS (SELECT a.nation, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.xy) AS xy FROM c a JOIN c b ON b.nation <> a.nation GROUP BY 1),
f AS (SELECT *, (xy - x * y / n) / (xx - x * x / n + l) AS b FROM t, (SELECT CAST(unnest([0.0, 10.0, 1000.0, 100000.0]) AS DOUBLE) AS l)), e AS (SELECT f.nation, f.l, avg(abs((f.y - b * f.x) / f.n + b * m.x - m.y)) AS e FROM m JOIN f USING (nation) GROUP BY 1, 2),
s AS (SELECT l AS penalty, avg(e) AS loss FROM e GROUP BY 1) SELECT penalty, round(loss, 6) AS loss, penalty = (SELECT max(penalty) FROM s WHERE loss <= (SELECT min(loss) FROM s) + 0.00002) AS chosen FROM s""")
def nested_penalty_choice(spark, folder):
    return rounded(L.choose_penalty(_monthly(spark, folder), "nation", "x", "y", [0.0, 10.0, 1000.0, 100000.0], 0.00002), "loss")


@query("""WITH r AS (SELECT k, p_retailprice AS y, pow(p_size, k / 100.0) AS x FROM part, range(1, 101) t(k) WHERE p_size > 0), f AS (SELECT k, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS sse FROM r GROUP BY 1)
SELECT k / 100.0 AS exponent, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(sse, 2) AS sse FROM f WHERE slope > 0 ORDER BY f.sse, k LIMIT 1""")
def profile_exponent(spark, folder):
    parts = T.table(spark, folder, "part").withColumn("size", F.col("p_size").cast("double"))
    return rounded(rounded(L.profile_exponent(parts, "size", "p_retailprice", 100), "slope", "intercept", digits=4), "sse", digits=2)


@query(f"""WITH {_MONTHLY}, f AS (SELECT nation, regr_slope(y, p) AS slope, regr_intercept(y, p) AS intercept FROM m GROUP BY 1) SELECT nation, round(CASE WHEN abs(slope) > 1e-12 THEN (12.0 - intercept) / slope END, 3) AS implied FROM f""")
def inverse_prediction(spark, folder):
    fits = _monthly(spark, folder).groupBy("nation").agg(F.regr_slope("y", "p").alias("slope"), F.regr_intercept("y", "p").alias("intercept"))
    return fits.select("nation", F.round(L.inverse_prediction(F.lit(12.0), F.col("slope"), F.col("intercept")), 3).alias("implied"))


@query(f"""WITH {_MONTHLY}, c AS (SELECT nation, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, row_number() OVER (ORDER BY nation) - 1 AS k FROM m GROUP BY 1), z AS (SELECT count(*) AS z FROM c),
d AS (SELECT b.d AS draw, {_draw('31', 'b.d', 'c.k')} % z AS k FROM range(300) b(d), c, z), s AS (SELECT draw, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM d JOIN c USING (k) GROUP BY 1),
v AS (SELECT draw, (n * xy - x * y) / (n * xx - x * x) AS slope FROM s), a AS (SELECT * FROM v WHERE slope > 0 ORDER BY draw LIMIT 100)
SELECT count(*) AS accepted, CAST(max(draw) + 1 AS INTEGER) AS tried, round(quantile_cont(slope, 0.05), 7) AS low, round(quantile_cont(slope, 0.5), 7) AS middle, round(quantile_cont(slope, 0.95), 7) AS high FROM a""")
def coefficient_bootstrap(spark, folder):
    return rounded(L.coefficient_bootstrap(_monthly(spark, folder), "nation", "x", "y", 100, 300, 31), "low", "middle", "high", digits=7)


# ---------------------------------------------------------------- weights


def _estimates(spark, folder):
    """Parts with a truth and three estimates, of which some are missing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return T.table(spark, folder, "part").select(
        "p_partkey",
        "p_brand",
        F.log("p_retailprice").alias("y"),
        F.when(k % 5 != 0, 7.0 + size / 100.0).alias("a"),
        (7.5 - size / 200.0).alias("b"),
        F.when(k % 3 != 0, 7.2 + (k % 10).cast("double") / 50).alias("c"),
    )


_ESTIMATES = """e AS (SELECT p_partkey, p_brand, ln(p_retailprice) AS y, CASE WHEN p_partkey % 5 <> 0 THEN 7.0 + p_size / 100.0 END AS a, 7.5 - p_size / 200.0 AS b, CASE WHEN p_partkey % 3 <> 0 THEN 7.2 + (p_partkey % 10) / 50.0 END AS c FROM part)"""


@query(f"""WITH {_ESTIMATES}, g AS (SELECT a.i AS w0, b.i AS w1, 10 - a.i - b.i AS w2 FROM range(11) a(i), range(11) b(i) WHERE a.i + b.i <= 10),
s AS (SELECT w0, w1, w2, abs((CASE WHEN a IS NULL THEN 0 ELSE w0 * a END + w1 * b + CASE WHEN c IS NULL THEN 0 ELSE w2 * c END) / nullif(CASE WHEN a IS NULL THEN 0 ELSE w0 END + w1 + CASE WHEN c IS NULL THEN 0 ELSE w2 END, 0) - y) AS e FROM e, g),
l AS (SELECT w0, w1, w2, avg(e * e) AS mse, avg(e) AS mae, median(e) AS median, quantile_cont(e, 0.8) AS p80 FROM s WHERE e IS NOT NULL GROUP BY 1, 2, 3),
u AS (UNPIVOT l ON mse, mae, median, p80 INTO NAME objective VALUE loss), r AS (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY round(loss, 9), w0, w1, w2) AS r FROM u)
SELECT objective, CAST(w0 AS INTEGER) AS w0, CAST(w1 AS INTEGER) AS w1, CAST(w2 AS INTEGER) AS w2, round(loss, 6) AS loss FROM r WHERE r = 1""")
def weight_search(spark, folder):
    return rounded(E.weight_search(_estimates(spark, folder), ["a", "b", "c"], "y", 10), "loss")


@query(f"""WITH {_ESTIMATES}, s AS (SELECT p_brand, w, sum(abs(w / 20.0 * a + (1 - w / 20.0) * b - y)) AS s, count(*) AS n FROM e, range(21) t(w) WHERE a IS NOT NULL GROUP BY 1, 2),
o AS (SELECT x.p_brand, x.w, x.s / x.n AS own, sum(z.s) / sum(z.n) AS loss FROM s x JOIN s z ON z.w = x.w AND z.p_brand <> x.p_brand GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(loss, 9), w) AS r FROM o)
SELECT p_brand, w / 20.0 AS weight, round(own, 6) AS mean_abs_error FROM r WHERE r = 1""")
def nested_blend_weights(spark, folder):
    return rounded(E.nested_blend(_estimates(spark, folder), "p_brand", "a", "b", "y"), "mean_abs_error")


@query(f"""WITH {_ESTIMATES}, s AS (SELECT p_brand, w, sum(pow(w / 20.0 * a + (1 - w / 20.0) * b - y, 2)) AS s, count(*) AS n FROM e, range(21) t(w) WHERE a IS NOT NULL GROUP BY 1, 2), c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM e WHERE a IS NOT NULL)), z AS (SELECT count(*) AS z FROM c),
d AS (SELECT b.d AS draw, {_draw('5', 'b.d', 'c.k')} % z AS k FROM range(200) b(d), c, z), l AS (SELECT draw, w, round(sum(s) / sum(n), 9) AS l FROM d JOIN c USING (k) JOIN s USING (p_brand) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY l, w) AS r FROM l)
SELECT w / 20.0 AS weight, count(*) AS draws FROM r WHERE r = 1 GROUP BY 1""")
def weight_bootstrap(spark, folder):
    return E.weight_bootstrap(_estimates(spark, folder).where("a is not null"), "p_brand", "a", "b", "y", 200, 5)


@query(f"""WITH {ORDERS}, c AS (SELECT nation, sum(y - 11.5) AS s, count(*) AS n, row_number() OVER (ORDER BY nation) - 1 AS k FROM orders_by_nation GROUP BY 1), m AS (SELECT count(*) AS m FROM c), d AS (SELECT b.d AS draw, {_draw('19', 'b.d', 'c.k')} % m AS k FROM range(400) b(d), c, m), v AS (SELECT draw, sum(s) / sum(n) AS v FROM d JOIN c USING (k) GROUP BY 1)
SELECT (SELECT round(sum(s) / sum(n), 6) FROM c) AS observed, (SELECT count(*) FROM c) AS clusters, round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high, round(avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END), 6) AS share_below_zero FROM v""")
def row_weighted_bootstrap(spark, folder):
    rows = orders_panel(spark, folder).withColumn("v", F.col("y") - 11.5)
    return rounded(resampling.cluster_bootstrap(rows, "nation", "v", 400, 19, by_row=True), "observed", "low", "high", "share_below_zero")


@query(f"""WITH r AS (SELECT s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier WHERE s_acctbal IS NOT NULL), c AS (SELECT s_nationkey, count(*) AS size, row_number() OVER (ORDER BY s_nationkey) - 1 AS k FROM r GROUP BY 1), m AS (SELECT count(*) AS m FROM c),
d AS (SELECT b.d AS draw, c.k AS slot, {_draw('41', 'b.d', 'c.k')} % m AS k FROM range(50) b(d), c, m), i AS (SELECT draw, slot, s_nationkey, size, unnest(range(size)) AS place FROM d JOIN c USING (k)), t AS (SELECT draw, slot, s_nationkey, {_draw('41', 'draw', 'slot', 'place')} % size AS r FROM i),
v AS (SELECT draw, avg(v) AS v FROM (SELECT draw, slot, avg(s_acctbal) AS v FROM t JOIN r USING (s_nationkey, r) GROUP BY 1, 2) GROUP BY 1) SELECT count(*) AS draws, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high FROM v""")
def two_level_bootstrap(spark, folder):
    return rounded(E.two_level_bootstrap(T.table(spark, folder, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", 50, 41), "mean", "low", "high", digits=6)


# ---------------------------------------------------------------- intervals


@query("""WITH e AS (SELECT p_type, p_brand, abs(p_retailprice - 1400) AS e FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY e) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM e), f AS (SELECT p_type, n, CAST(ceil((n + 1) * 0.8) AS BIGINT) AS rank, max(e) FILTER (r = CAST(ceil((n + 1) * 0.8) AS BIGINT)) AS factor FROM r GROUP BY 1, 2)
SELECT p_type, n, rank, round(factor, 4) AS factor, round(max(factor) OVER (), 4) AS envelope FROM f WHERE factor IS NOT NULL""")
def factor_envelope(spark, folder):
    errors = T.table(spark, folder, "part").withColumn("e", F.abs(F.col("p_retailprice") - 1400))
    return rounded(E.factor_envelope(errors, ["p_type"], "e", 0.8), "factor", "envelope", digits=4)


@query(f"""WITH {_MONTHLY}, t AS (SELECT nation, day, CASE WHEN o_totalprice BETWEEN 100000 AND 400000 THEN 1.0 ELSE 0.0 END AS h FROM m), l AS (SELECT nation, max(day) AS day FROM t GROUP BY 1), g AS (SELECT nation, avg(h) AS h FROM t GROUP BY 1), z AS (SELECT nation, avg(h) AS h FROM t JOIN l USING (nation, day) GROUP BY 1)
SELECT (SELECT count(*) FROM t) AS tests, (SELECT round(avg(h), 6) FROM t) AS raw_rate, (SELECT round(avg(h), 6) FROM g) AS group_balanced_rate, (SELECT round(avg(h), 6) FROM z) AS latest_rate""")
def coverage_rates(spark, folder):
    scored = _monthly(spark, folder).withColumn("hit", F.col("o_totalprice").between(100000, 400000))
    return rounded(E.coverage_rates(scored, "nation", "day", "hit"), "raw_rate", "group_balanced_rate", "latest_rate")


def _u(seed: int) -> str:
    return f"(({_draw(str(seed), 's_suppkey', 'd')}) + 0.5) / 4294967296.0"


@query(f"""WITH r AS (SELECT s_suppkey, s_acctbal, d, abs(sqrt(-2 * ln({_u(3)})) * cos(2 * pi() * {_u(4)})) AS z, {_u(5)} AS u FROM supplier, range(40) t(d)), v AS (SELECT s_suppkey, CASE WHEN u < 0.5 THEN s_acctbal - z * 100 ELSE s_acctbal + z * 300 END AS v FROM r)
SELECT s_suppkey, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.1), 3) AS low, round(quantile_cont(v, 0.9), 3) AS high FROM v GROUP BY 1""")
def split_half_normal(spark, folder):
    suppliers = T.table(spark, folder, "supplier").withColumn("low", F.col("s_acctbal") - 100).withColumn("high", F.col("s_acctbal") + 300)
    drawn = E.split_half_normal(suppliers, ["s_suppkey"], "s_acctbal", "low", "high", 40, 3)
    out = drawn.groupBy("s_suppkey").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.1)).alias("low"), F.percentile("value", F.lit(0.9)).alias("high"))
    return rounded(out, "mean", "low", "high", digits=3)


@query("""WITH k AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.1) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.9) AS c FROM orders GROUP BY 1), g AS (SELECT *, unnest([0.05, 0.1, 0.3, 0.5, 0.8, 0.95]) AS p FROM k)
SELECT o_orderpriority, CAST(p AS DOUBLE) AS p, round(CASE WHEN p <= 0.1 THEN a WHEN p <= 0.5 THEN exp(ln(a) + (p - 0.1) / 0.4 * (ln(b) - ln(a))) WHEN p <= 0.9 THEN exp(ln(b) + (p - 0.5) / 0.4 * (ln(c) - ln(b))) ELSE c END, 2) AS value FROM g""")
def quantile_reconstruction(spark, folder):
    known = A.quantiles(T.table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice", {"a": 0.1, "b": 0.5, "c": 0.9})
    levels = known.select("o_orderpriority", F.array("a", "b", "c").alias("k")).withColumn("p", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.3, 0.5, 0.8, 0.95)))))
    value = E.quantile_function(F.col("p"), [(q, F.col("k")[i]) for i, q in enumerate((0.1, 0.5, 0.9))])
    return levels.select("o_orderpriority", "p", F.round(value, 2).alias("value"))


@query(f"""WITH {_MONTHLY}, r AS (SELECT nation, x, o_totalprice AS v, max(o_totalprice) OVER (PARTITION BY nation ORDER BY x, o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m), f AS (SELECT nation, count(*) AS points, regr_slope(log2(v), x) AS slope FROM r WHERE b IS NULL OR v > b GROUP BY 1)
SELECT nation, points, round(slope, 6) AS slope, round(pow(2, slope), 6) AS growth, round(CASE WHEN slope > 0 THEN 1 / slope END, 4) AS doubling_years FROM f WHERE slope IS NOT NULL""")
def frontier_doubling_time(spark, folder):
    rows = _monthly(spark, folder).select("nation", "x", F.col("o_totalprice").alias("v"))
    records = W.running_records(rows, ["nation"], "x", "v")
    return rounded(rounded(E.doubling_time(records, ["nation"], "x", "v"), "slope", "growth"), "doubling_years", digits=4)


@query("""SELECT p_partkey, round(1000 * pow(10, 0.02 * (p_size - 25) + 0.1 * (p_partkey % 4)), 4) AS anchored FROM part""")
def anchored_extrapolation(spark, folder):
    out = E.anchored(F.lit(1000.0), F.lit(0.02), F.col("p_size") - 25, F.lit(0.1), (F.col("p_partkey") % 4).cast("double"))
    return T.table(spark, folder, "part").select("p_partkey", F.round(out, 4).alias("anchored"))


@query("""WITH f AS (SELECT l_returnflag, regr_slope(ln(l_quantity), l_discount) AS ps, regr_intercept(ln(l_quantity), l_discount) AS pi, regr_slope(ln(l_extendedprice / l_quantity), l_discount) AS qs, regr_intercept(ln(l_extendedprice / l_quantity), l_discount) AS qi FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1)
SELECT l_returnflag, round(avg(exp(pi + ps * l_discount)), 5) AS part, round(avg(exp(qi + qs * l_discount)), 4) AS ratio, round(avg(exp(pi + ps * l_discount) * exp(qi + qs * l_discount)), 3) AS whole FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1""")
def two_quantity_transport(spark, folder):
    out = E.transported(T.table(spark, folder, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", "l_extendedprice")
    return out.groupBy("l_returnflag").agg(F.round(F.avg("part_predicted"), 5).alias("part"), F.round(F.avg("ratio_predicted"), 4).alias("ratio"), F.round(F.avg("whole_predicted"), 3).alias("whole"))


# ---------------------------------------------------------------- comparisons


@query("""SELECT p_brand, median(p_retailprice) FILTER (p_type = 'ECONOMY') AS own_median, median(p_retailprice) AS mixed_median, round(median(p_retailprice) / median(p_retailprice) FILTER (p_type = 'ECONOMY'), 6) AS ratio FROM part GROUP BY 1 HAVING count(*) FILTER (p_type = 'ECONOMY') > 0""")
def counterfactual_medians(spark, folder):
    return rounded(E.counterfactual_medians(T.table(spark, folder, "part"), ["p_brand"], "p_retailprice", F.col("p_type") == "ECONOMY"), "ratio")


@query("""WITH s AS (SELECT 'base' AS scenario, c_mktsegment, c_acctbal AS v FROM customer UNION ALL SELECT 'first is richer', c_mktsegment, CASE WHEN c_custkey = 0 THEN 100000.0 ELSE c_acctbal END FROM customer UNION ALL SELECT 'two are poor', c_mktsegment, CASE WHEN c_custkey IN (1, 2) THEN 0.0 ELSE c_acctbal END FROM customer),
a AS (SELECT scenario, c_mktsegment, avg(v) AS balance FROM s GROUP BY 1, 2) SELECT a.scenario, c_mktsegment, round(a.balance, 4) AS balance, round(100 * (a.balance / b.balance - 1), 6) AS change_percent FROM a JOIN (SELECT * FROM a WHERE scenario = 'base') b USING (c_mktsegment)""")
def scenario_sensitivity(spark, folder):
    run = lambda df: df.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("balance"))
    out = E.scenarios(T.table(spark, folder, "customer"), "c_custkey", "c_acctbal", {"first is richer": {0: 100000.0}, "two are poor": {1: 0.0, 2: 0.0}}, run)
    return rounded(rounded(E.percent_change(out, ["c_mktsegment"], "balance"), "change_percent"), "balance", digits=4)


@query("""WITH t AS (SELECT user_id, event_type, value, event_id % 2 = 0 AS train FROM events), s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM t WHERE train GROUP BY 1)
SELECT user_id, round(avg((value - m) / d), 6) AS "index", count((value - m) / d) AS tasks FROM t JOIN s USING (event_type) WHERE d > 0 GROUP BY 1""")
def composite_index(spark, folder):
    return rounded(E.composite_index(T.table(spark, folder, "events"), "user_id", "event_type", "value", F.col("event_id") % 2 == 0), "index")


@query("""WITH r AS (SELECT p_brand, p_name, p_type = 'ECONOMY' AS t, p_size AS v, row_number() OVER (PARTITION BY p_brand, p_type = 'ECONOMY' ORDER BY p_size DESC, p_name) AS r FROM part) SELECT a.p_brand, a.p_name AS treated, b.p_name AS untreated, a.v - b.v AS uplift FROM r a JOIN r b USING (p_brand) WHERE a.t AND NOT b.t AND a.r = 1 AND b.r = 1""")
def matched_pairs(spark, folder):
    return E.matched_pairs(T.table(spark, folder, "part"), ["p_brand"], F.col("p_type") == "ECONOMY", "p_size", "p_name")


@query(f"""WITH {_MONTHLY}, a AS (SELECT nation, regr_slope(y, x) AS v FROM m WHERE day < DATE '1998-01-01' GROUP BY 1), b AS (SELECT nation, regr_slope(y, x) AS v FROM m WHERE day < DATE '1998-01-01' AND o_orderstatus <> 'P' AND nation <> 3 GROUP BY 1)
SELECT nation, CASE WHEN b.v IS NULL THEN 'first only' WHEN abs(a.v - b.v) <= 0.01 THEN 'same' ELSE 'changed' END AS status, round(a.v, 6) AS first, round(b.v, 6) AS second FROM a LEFT JOIN b USING (nation)""")
def timing_comparison(spark, folder):
    early = _monthly(spark, folder).where("day < '1998-01-01'")
    fit = lambda df: df.groupBy("nation").agg(F.regr_slope("y", "x").alias("v"))
    return rounded(E.compared(fit(early), fit(early.where("o_orderstatus <> 'P' and nation <> 3")), ["nation"], "v", 0.01), "first", "second")


@query(f"""WITH {_MONTHLY}, a AS (SELECT nation, regr_slope(y, x) AS v FROM m GROUP BY 1), b AS (SELECT nation, regr_slope(y, x) AS v FROM m WHERE nation % 5 <> 0 OR o_orderstatus <> 'P' GROUP BY 1)
SELECT nation, CASE WHEN abs(a.v - b.v) <= 1e-6 THEN 'same' ELSE 'changed' END AS status, round(a.v, 6) AS first, round(b.v, 6) AS second FROM a JOIN b USING (nation)""")
def recomputation_audit(spark, folder):
    """The slope by sums, and recomputed by the built-in aggregate from rows of which every fifth nation lacks some: the audit finds these."""
    rows = _monthly(spark, folder)
    first = L.weighted_fit(rows, ["nation"], ["x"], "y").select("nation", F.col("b1").alias("v"))
    second = rows.where("nation % 5 <> 0 or o_orderstatus <> 'P'").groupBy("nation").agg(F.regr_slope("y", "x").alias("v"))
    return rounded(E.compared(first, second, ["nation"], "v", 1e-6), "first", "second")


@query("""WITH t AS (SELECT p_brand, max(p_size) AS top FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1) SELECT p_partkey, coalesce(p_size > top, true) AS beyond, round(p_size / top, 6) AS extrapolation FROM part LEFT JOIN t USING (p_brand) WHERE p_partkey % 4 = 0""")
def out_of_support(spark, folder):
    out = E.support(T.table(spark, folder, "part"), ["p_brand"], F.col("p_partkey") % 4 != 0, "p_size").where("p_partkey % 4 = 0")
    return rounded(out.select("p_partkey", "beyond", "extrapolation"), "extrapolation")


@query("""WITH f AS (SELECT exp(avg(ln(p_retailprice / (800 + 20 * p_size)))) AS f FROM part WHERE p_partkey % 10 = 0) SELECT p_partkey, round(f, 6) AS factor, round((800 + 20 * p_size) * f, 4) AS calibrated FROM part, f""")
def anchor_calibration(spark, folder):
    parts = T.table(spark, folder, "part").withColumn("estimate", (800 + 20 * F.col("p_size")).cast("double"))
    out = E.calibrated(parts, F.col("p_partkey") % 10 == 0, "p_retailprice", "estimate")
    return out.select("p_partkey", F.round("factor", 6).alias("factor"), F.round("calibrated", 4).alias("calibrated"))


@query("""WITH e AS (SELECT p_partkey, 800 + 20.0 * p_size AS c, log10((800 + 20.0 * p_size) / p_retailprice) AS e FROM part), f AS (SELECT pow(10, quantile_cont(abs(e), 0.8)) AS f FROM e WHERE p_partkey % 3 = 0) SELECT p_partkey, round(c / f, 4) AS low, round(c * f, 4) AS high FROM e, f""")
def held_out_band(spark, folder):
    parts = T.table(spark, folder, "part").withColumn("c", 800 + 20.0 * F.col("p_size")).withColumn("e", F.log10(F.col("c") / F.col("p_retailprice")))
    return rounded(E.error_band(parts, F.col("p_partkey") % 3 == 0, "e", "c").select("p_partkey", "low", "high"), "low", "high", digits=4)
