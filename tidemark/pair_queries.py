"""Queries of matching without reuse, of similar texts, and of order statistics before a day, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pairing as P
from tidemark.operators.freezes import digest_tree, row_digests, verify_freeze
from tidemark.operators.prefixes import prefix_medians, prefix_ranks
from tidemark.plans import resampling as R
from tidemark.plans.nested import nested_selection
from tidemark.plans.simplex import simplex_search
from tidemark.registry import ORDERS, orders_panel, query, rounded
from tidemark.sources import tables as T


@query(f"""WITH {ORDERS}, c AS (SELECT nation, day, o_totalprice AS price, count(*) AS n FROM orders_by_nation GROUP BY 1, 2, 3),
p AS (SELECT c.nation, c.day, c.price, any_value(c.n) AS n, sum(e.n) AS earlier, sum(CASE WHEN e.price <= c.price THEN e.n ELSE 0 END) AS low FROM c JOIN c e ON e.nation = c.nation AND e.day < c.day GROUP BY 1, 2, 3)
SELECT nation, day, price, CAST(n AS BIGINT) AS "rows", CAST(earlier AS BIGINT) AS earlier, round(low / earlier, 6) AS share FROM p""")
def prefix_percentile_rank(spark, folder):
    rows = orders_panel(spark, folder).select("nation", "day", F.col("o_totalprice").alias("price"))
    return rounded(prefix_ranks(rows, ["nation"], "day", "price"), "share")


@query(f"""WITH {ORDERS} SELECT d.nation, d.day, round(median(h.o_totalprice), 4) AS median, count(*) AS n FROM (SELECT DISTINCT nation, day FROM orders_by_nation WHERE o_orderstatus = 'O') d
JOIN orders_by_nation h ON h.nation = d.nation AND h.day < d.day AND h.o_orderstatus = 'F' GROUP BY 1, 2""")
def running_medians(spark, folder):
    rows = orders_panel(spark, folder)
    out = prefix_medians(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), ["nation"], "day", "o_totalprice")
    return rounded(out, "median", digits=4)


_LEFT = "SELECT o_orderkey AS l, nation, o_orderpriority AS p, day, o_totalprice AS v FROM orders_by_nation WHERE o_orderstatus = 'F'"
_RIGHT = "SELECT o_orderkey AS r, nation, o_orderpriority AS p, day, o_totalprice AS v FROM orders_by_nation WHERE o_orderstatus = 'O'"


@query(f"""WITH RECURSIVE {ORDERS}, e AS (SELECT l, r, row_number() OVER (ORDER BY round(abs(ln(b.v / a.v)), 9), abs(date_diff('day', a.day, b.day)), l, r) AS s
FROM ({_LEFT}) a JOIN ({_RIGHT}) b ON a.nation = b.nation AND a.p = b.p AND abs(date_diff('day', a.day, b.day)) <= 45 AND b.v / a.v BETWEEN 0.8 AND 1.2),
g AS (SELECT l, r, s, false AS won FROM e
UNION ALL SELECT l, r, s, won FROM (SELECT *, bool_or(won) OVER (PARTITION BY l) OR bool_or(won) OVER (PARTITION BY r) AS used FROM (SELECT l, r, s, s = min(s) OVER (PARTITION BY l) AND s = min(s) OVER (PARTITION BY r) AS won FROM g WHERE NOT won)) WHERE won OR NOT used)
SELECT l AS order_f, r AS order_o FROM g WHERE won""")
def one_to_one_match(spark, folder):
    rows = orders_panel(spark, folder).select("nation", F.col("o_orderpriority").alias("p"), "day", F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    side = lambda s: rows.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    found = P.window_match(side("F"), side("O"), "k", ["nation", "p"], "day", 45, "v", 0.8, 1.2)
    return found.select(F.col("left").alias("order_f"), F.col("right").alias("order_o"))


@query("""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM conversations)
SELECT a.w AS "left", b.w AS "right", round(1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)), 6) AS similarity
FROM a JOIN b ON abs(length(a.w) - length(b.w)) <= 0.3 * greatest(length(a.w), length(b.w)) WHERE levenshtein(a.w, b.w) <= floor(0.3 * greatest(length(a.w), length(b.w)) + 1e-9)""")
def similar_words(spark, folder):
    words = lambda t: T.table(spark, folder, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), 0)).alias("w"))
    return rounded(P.similar_pairs(words("benchmark"), words("conversations"), 0.7), "similarity")


@query("""SELECT o_orderkey, substr(sha256('{"o_orderkey":' || o_orderkey || '}'), 1, 2) AS range, change FROM (
SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 1 THEN 'removed' WHEN o_orderkey % 97 = 0 THEN 'changed' END AS change FROM orders UNION ALL SELECT o_orderkey + 100000000, 'added' FROM orders WHERE o_orderkey % 1013 = 2) WHERE change IS NOT NULL""")
def freeze_verification(spark, folder):
    """Orders are frozen, then some are changed, removed and added; verification names these and no others."""
    orders = T.table(spark, folder, "orders")
    changed = orders.where("o_orderkey % 1009 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    added = orders.where("o_orderkey % 1013 = 2").withColumn("o_orderkey", F.col("o_orderkey") + 100000000)
    return verify_freeze(row_digests(orders, ["o_orderkey"]), changed.unionByName(added), ["o_orderkey"]).select("o_orderkey", "range", "change")


@query("""WITH r AS (SELECT substr(sha256('{"o_orderkey":' || o_orderkey || '}'), 1, 2) AS f FROM orders) SELECT level, substr(f, 1, level) AS range, count(*) AS rows FROM r, range(3) t(level) GROUP BY 1, 2""")
def freeze_ranges(spark, folder):
    return digest_tree(row_digests(T.table(spark, folder, "orders"), ["o_orderkey"])).select(F.col("level").cast("long").alias("level"), "range", "rows")


_PREDICTORS = """e AS (SELECT ln(p_retailprice) AS y, CASE WHEN p_partkey % 5 <> 0 THEN 7.0 + p_size / 100.0 END AS a, 7.5 - p_size / 200.0 AS b, CASE WHEN p_partkey % 3 <> 0 THEN 7.2 + (p_partkey % 10) / 50.0 END AS c, CASE WHEN p_partkey % 7 <> 0 THEN 6.8 + (p_partkey % 13) / 40.0 END AS d FROM part)"""


@query(f"""WITH {_PREDICTORS}, g AS (SELECT a.i AS w0, b.i AS w1, c.i AS w2, 50 - a.i - b.i - c.i AS w3 FROM range(51) a(i), range(51) b(i), range(51) c(i) WHERE a.i + b.i + c.i <= 50),
s AS (SELECT w0, w1, w2, w3, abs((CASE WHEN a IS NULL THEN 0 ELSE w0 * a END + w1 * b + CASE WHEN c IS NULL THEN 0 ELSE w2 * c END + CASE WHEN d IS NULL THEN 0 ELSE w3 * d END) / nullif(CASE WHEN a IS NULL THEN 0 ELSE w0 END + w1 + CASE WHEN c IS NULL THEN 0 ELSE w2 END + CASE WHEN d IS NULL THEN 0 ELSE w3 END, 0) - y) AS e FROM e, g),
l AS (SELECT w0, w1, w2, w3, avg(e * e) AS mse, avg(e) AS mae, median(e) AS median, quantile_cont(e, 0.8) AS p80 FROM s GROUP BY 1, 2, 3, 4 HAVING count(e) = count(*)),
u AS (UNPIVOT l ON mse, mae, median, p80 INTO NAME objective VALUE loss), r AS (SELECT *, row_number() OVER (PARTITION BY objective ORDER BY round(loss, 9), w0, w1, w2) AS r FROM u)
SELECT objective, CAST(w0 AS INTEGER) AS w0, CAST(w1 AS INTEGER) AS w1, CAST(w2 AS INTEGER) AS w2, CAST(w3 AS INTEGER) AS w3, round(loss, 6) AS loss FROM r WHERE r = 1""")
def fine_weight_search(spark, folder):
    """Four predictors in steps of 0.02: the best of 23,426 vectors for each objective."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = T.table(spark, folder, "part").select(
        F.log("p_retailprice").alias("y"),
        F.when(k % 5 != 0, 7.0 + size / 100).alias("a"),
        (7.5 - size / 200).alias("b"),
        F.when(k % 3 != 0, 7.2 + (k % 10) / 50).alias("c"),
        F.when(k % 7 != 0, 6.8 + (k % 13) / 40).alias("d"),
    )
    return rounded(simplex_search(rows, ["a", "b", "c", "d"], "y").drop("evaluated"), "loss")


def _one_feature(x: str, train: str, held: str) -> str:
    """The mean squared error on one set of sums of a line with penalty l fitted to another, and the line."""
    t = lambda c: f"{train}.{c}"
    b = f"({t(x + 'y')} - {t(x)} * {t('y')} / {t('n')}) / ({t(x + x)} - {t(x)} * {t(x)} / {t('n')} + l)"
    a = f"(({t('y')} - ({b}) * {t(x)}) / {t('n')})"
    v = lambda c: f"{held}.{c}"
    return f"({v('yy')} - 2 * {a} * {v('y')} - 2 * ({b}) * {v(x + 'y')} + {a} * {a} * {v('n')} + 2 * {a} * ({b}) * {v(x)} + ({b}) * ({b}) * {v(x + x)}) / {v('n')}"


_SUMS = ("n", "x", "p", "y", "xx", "pp", "xy", "py", "yy")
_SUMMED = "count(*) AS n, sum(x) AS x, sum(p) AS p, sum(y) AS y, sum(x * x) AS xx, sum(p * p) AS pp, sum(x * y) AS xy, sum(p * y) AS py, sum(y * y) AS yy"
_LESS = ", ".join(f"t.{c} - g.{c} AS {c}" for c in _SUMS)
_LESS_TWO = ", ".join(f"o.{c} - v.{c} AS {c}" for c in _SUMS)
_ADDED = ", ".join(f"sum({c}) AS {c}" for c in _SUMS)
_LINE = lambda x: f"""SELECT o.nation, o.yr, '{x}' AS f, l, ({x}y - {x} * y / n) / ({x}{x} - {x} * {x} / n + l) AS b, (y - ({x}y - {x} * y / n) / ({x}{x} - {x} * {x} / n + l) * {x}) / n AS a FROM o, k WHERE k.f = '{x}'"""


@query(f"""WITH {ORDERS}, m AS (SELECT nation, year(o_orderdate) AS yr, x, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS p, y FROM orders_by_nation), k AS (SELECT * FROM (VALUES (0, 'x', 0.0), (1, 'x', 2000.0), (2, 'p', 0.0), (3, 'p', 2000.0)) k(policy, f, l)),
c AS (SELECT nation, yr, {_SUMMED} FROM m GROUP BY 1, 2), h AS (SELECT f.nation, f.yr, {_ADDED} FROM (SELECT DISTINCT a.nation, b.yr FROM c a, c b) f JOIN c e ON e.nation = f.nation AND e.yr < f.yr GROUP BY 1, 2), t AS (SELECT yr, {_ADDED} FROM h GROUP BY 1),
o AS (SELECT c.nation, c.yr, {_LESS} FROM c JOIN h g USING (nation, yr) JOIN t USING (yr)), i AS (SELECT o.nation, o.yr, v.nation AS h, {_LESS_TWO} FROM o JOIN h v ON v.yr = o.yr AND v.nation <> o.nation),
e AS (SELECT i.nation, i.yr, policy, avg(CASE f WHEN 'x' THEN {_one_feature('x', 'i', 'v')} ELSE {_one_feature('p', 'i', 'v')} END) AS loss FROM i JOIN h v ON v.yr = i.yr AND v.nation = i.h CROSS JOIN k GROUP BY 1, 2, 3),
r AS (SELECT e.*, row_number() OVER (PARTITION BY nation, yr ORDER BY -l, policy) AS r FROM (SELECT *, min(loss) OVER (PARTITION BY nation, yr) AS best FROM e) e JOIN k USING (policy) WHERE loss <= best + 0.0001),
z AS ({_LINE('x')} UNION ALL {_LINE('p')}), w AS (SELECT r.nation, r.yr, r.policy, r.loss, z.a, z.b, k.f FROM r JOIN k USING (policy) JOIN z ON z.nation = r.nation AND z.yr = r.yr AND z.f = k.f AND z.l = k.l WHERE r = 1)
SELECT m.nation, m.yr, CAST(any_value(policy) AS INTEGER) AS policy, round(any_value(loss), 6) AS inner_loss, count(*) AS tests, round(avg(abs(w.a + w.b * CASE w.f WHEN 'x' THEN m.x ELSE m.p END - m.y)), 6) AS mean_abs_error FROM m JOIN w USING (nation, yr) GROUP BY 1, 2""")
def nested_policy_choice(spark, folder):
    """Each nation and year under the policy that leaving out the other nations in earlier years chooses."""
    rows = orders_panel(spark, folder).select("nation", F.year("o_orderdate").alias("yr"), "x", F.substring("o_orderpriority", 1, 1).cast("double").alias("p"), "y")
    policies = [(("x",), 0.0), (("x",), 2000.0), (("p",), 0.0), (("p",), 2000.0)]
    out = nested_selection(rows, "nation", ["x", "p"], "y", policies, "yr", tolerance=0.0001)
    return rounded(out.select("nation", F.col("yr").cast("long").alias("yr"), "policy", "inner_loss", "tests", "mean_abs_error"), "inner_loss", "mean_abs_error")


# ---------------------------------------------------------------- resampling without numbered clusters


def _poisson(*parts: str) -> str:
    """The SQL of a Poisson number of mean 1 from a digest."""
    number = "CAST('0x' || substr(md5({}), 1, 8) AS UBIGINT)".format(" || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))
    cases = " ".join(f"WHEN u < {limit} THEN {k}" for k, limit in enumerate(R.POISSON))
    return f"(SELECT CASE {cases} ELSE {len(R.POISSON)} END FROM (SELECT {number} AS u))"


_SPREAD = "round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.5), 6) AS middle, round(quantile_cont(v, 0.95), 6) AS high, round(avg(CAST(v < 0 AS INTEGER)), 6) AS share_below_zero, count(v) AS defined"
_ERRORS = "e AS (SELECT o_custkey AS k, o_orderpriority AS p, y - 11.7 AS v FROM orders_by_nation)"
_DRAWS = 200


def _errors(spark, folder):
    return orders_panel(spark, folder).select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), (F.col("y") - 11.7).alias("v"))


def _spread_rounded(df):
    return rounded(df, "observed", "low", "middle", "high", "share_below_zero")


@query(f"""WITH {ORDERS}, {_ERRORS}, c AS (SELECT k, avg(v) AS m FROM e GROUP BY 1), d AS (SELECT d AS draw, {_poisson('7', 'd', 'k')} AS w, m FROM c, range({_DRAWS}) r(d)), s AS (SELECT draw, sum(w * m) / sum(w) AS v FROM d GROUP BY 1)
SELECT round((SELECT avg(m) FROM c), 6) AS observed, (SELECT count(*) FROM c) AS clusters, {_SPREAD} FROM s""")
def poisson_cluster_bootstrap(spark, folder):
    return _spread_rounded(R.poisson_bootstrap(_errors(spark, folder), ["k"], "v", _DRAWS, 7))


@query(f"""WITH {ORDERS}, {_ERRORS}, c AS (SELECT k, sum(v) AS s, count(*) AS n FROM e GROUP BY 1), d AS (SELECT d AS draw, {_poisson('8', 'd', 'k')} AS w, s, n FROM c, range({_DRAWS}) r(d)), s AS (SELECT draw, sum(w * s) / sum(w * n) AS v FROM d GROUP BY 1)
SELECT round((SELECT sum(s) / sum(n) FROM c), 6) AS observed, (SELECT count(*) FROM c) AS clusters, {_SPREAD} FROM s""")
def poisson_row_bootstrap(spark, folder):
    return _spread_rounded(R.poisson_bootstrap(_errors(spark, folder), ["k"], "v", _DRAWS, 8, by_row=True))


@query(f"""WITH {ORDERS}, {_ERRORS}, c AS (SELECT k, p, avg(v) AS m FROM e GROUP BY 1, 2), d AS (SELECT d AS draw, {_poisson('9', 'd', 'k')} * {_poisson('10', 'd', 'k', 'p')} AS w, m FROM c, range({_DRAWS}) r(d)), s AS (SELECT draw, sum(w * m) / sum(w) AS v FROM d GROUP BY 1)
SELECT round((SELECT avg(m) FROM c), 6) AS observed, (SELECT count(*) FROM c) AS clusters, {_SPREAD} FROM s""")
def poisson_two_level_bootstrap(spark, folder):
    return _spread_rounded(R.poisson_bootstrap(_errors(spark, folder), ["p"], "v", _DRAWS, 9, outer=["k"]))


@query(f"""WITH {ORDERS}, c AS (SELECT o_custkey AS k, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM orders_by_nation GROUP BY 1), d AS (SELECT d AS draw, {_poisson('11', 'd', 'k')} AS w, c.* FROM c, range({_DRAWS}) r(d)),
s AS (SELECT draw, sum(w * n) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * xx) AS xx, sum(w * xy) AS xy FROM d GROUP BY 1), b AS (SELECT (n * xy - x * y) / (n * xx - x * x) AS b FROM s), z AS (SELECT CASE WHEN b > 0 THEN b END AS v FROM b) SELECT {_SPREAD} FROM z""")
def poisson_coefficient_bootstrap(spark, folder):
    """The slope over draws; draws without a rising line aren't defined and don't count."""
    rows = orders_panel(spark, folder)
    cells = rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(n) for n, c in {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y")}.items()))
    each = R.poisson_sums(cells, [["o_custkey"]], [], {c: F.col(c) for c in ("n", "x", "y", "xx", "xy")}, _DRAWS, 11)
    slope = F.expr("(n * xy - x * y) / (n * xx - x * x)")
    return rounded(R.spread(each, F.when(slope > 0, slope)), "low", "middle", "high", "share_below_zero")


@query(f"""WITH {_PREDICTORS.replace('SELECT ln', 'SELECT p_partkey % 400 AS g, ln')}, c AS (SELECT g, w, sum(pow(w / 20.0 * a + (1 - w / 20.0) * c - y, 2)) AS s, count(*) AS n FROM e, range(21) t(w) WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2), d AS (SELECT d AS draw, {_poisson('12', 'd', 'g')} AS m, c.* FROM c, range({_DRAWS}) r(d)),
l AS (SELECT draw, w, round(sum(m * s) / sum(m * n), 9) AS l FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY l, w) AS r FROM l) SELECT w / 20.0 AS weight, count(*) AS draws FROM r WHERE r = 1 GROUP BY 1""")
def poisson_weight_bootstrap(spark, folder):
    """How often each blend weight is the best one over draws of groups."""
    rows = T.table(spark, folder, "part").where("p_partkey % 5 <> 0 and p_partkey % 3 <> 0").select((F.col("p_partkey") % 400).alias("g"), F.log("p_retailprice").alias("y"), (7.0 + F.col("p_size") / 100).alias("a"), (7.2 + (F.col("p_partkey") % 10) / 50).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("w"))
    cells = rows.groupBy("g", "w").agg(F.sum(F.expr("pow(w / 20 * a + (1 - w / 20) * c - y, 2)")).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    each = R.poisson_sums(cells, [["g"]], ["w"], {"s": F.col("s"), "n": F.col("n")}, _DRAWS, 12)
    best = each.groupBy("draw").agg(F.min(F.struct(F.round(F.col("s") / F.col("n"), 9).alias("l"), "w")).alias("_b"))
    return best.groupBy((F.col("_b.w") / 20).alias("weight")).agg(F.count(F.lit(1)).alias("draws"))
