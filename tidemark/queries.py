"""One query per operator over the test tables, each with the SQL that gives the same rows.

Doubles are rounded here, at the boundary, since engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A
from tidemark.operators import matching as M
from tidemark.operators import windows as W
from tidemark.operators.prefixes import prefix_ranks
from tidemark.plans import ensembles, linear, regression, resampling
from tidemark.registry import ORDERS as _ORDERS
from tidemark.registry import QUERIES, SQL, Query, query, rounded
from tidemark.registry import orders_panel as _orders
from tidemark.sources import tables as T
from tidemark.streaming import events as streams


# ---------------------------------------------------------------- aggregates


@query("SELECT l_returnflag, l_linestatus, round(exp(avg(ln(l_extendedprice))), 4) AS geomean, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2")
def geomean_by_group(spark, folder):
    items = T.table(spark, folder, "lineitem").where("l_extendedprice > 0")
    return rounded(items.groupBy("l_returnflag", "l_linestatus").agg(A.geometric_mean(F.col("l_extendedprice")).alias("geomean"), F.count(F.lit(1)).alias("n")), "geomean", digits=4)


@query("SELECT l_returnflag, round(exp(sum(l_quantity * ln(l_extendedprice)) / sum(l_quantity)), 4) AS geomean FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def weighted_geomean(spark, folder):
    items = T.table(spark, folder, "lineitem")
    return rounded(items.groupBy("l_returnflag").agg(A.weighted_geometric_mean(F.col("l_extendedprice"), F.col("l_quantity")).alias("geomean")), "geomean", digits=4)


_BUNDLE = ("median_factor", "geomean_factor", "rmse_log10", "bias_factor", "within_1_5", "within_2", "within_3", "p80_factor", "p90_factor")


@query("""WITH e AS (SELECT o_orderpriority, log10(o_totalprice / 150000.0) AS e FROM orders WHERE o_totalprice > 0)
SELECT o_orderpriority, count(*) AS n, round(pow(10, median(abs(e))), 6) AS median_factor, round(pow(10, avg(abs(e))), 6) AS geomean_factor,
 round(sqrt(avg(e * e)), 6) AS rmse_log10, round(pow(10, avg(e)), 6) AS bias_factor,
 round(avg(CASE WHEN abs(e) <= log10(1.5) THEN 1.0 ELSE 0.0 END), 6) AS within_1_5, round(avg(CASE WHEN abs(e) <= log10(2.0) THEN 1.0 ELSE 0.0 END), 6) AS within_2,
 round(avg(CASE WHEN abs(e) <= log10(3.0) THEN 1.0 ELSE 0.0 END), 6) AS within_3,
 round(pow(10, quantile_cont(abs(e), 0.8)), 6) AS p80_factor, round(pow(10, quantile_cont(abs(e), 0.9)), 6) AS p90_factor
FROM e GROUP BY 1""")
def error_metric_bundle(spark, folder):
    errors = T.table(spark, folder, "orders").where("o_totalprice > 0").withColumn("e", F.log10(F.col("o_totalprice") / 150000.0))
    return rounded(A.error_bundle(errors, ["o_orderpriority"], "e"), *_BUNDLE)


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(median(l_extendedprice), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
FROM lineitem GROUP BY 1""")
def exact_quantiles(spark, folder):
    return rounded(A.quantiles(T.table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "p10", "p50", "p90", digits=4)


@query("""WITH s AS (SELECT l_returnflag, l_discount, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_discount) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
SELECT l_returnflag, min(l_discount) AS weighted_median FROM c WHERE c >= t / 2 GROUP BY 1""")
def weighted_median_by_group(spark, folder):
    return A.weighted_median(T.table(spark, folder, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


@query("""WITH s AS (SELECT l_returnflag, l_discount AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
p AS (SELECT *, (sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY l_returnflag) AS p FROM s),
b AS (SELECT *, lead(v) OVER (PARTITION BY l_returnflag ORDER BY v) AS v2, lead(p) OVER (PARTITION BY l_returnflag ORDER BY v) AS p2 FROM p)
SELECT l_returnflag, round(coalesce(max(CASE WHEN p <= 0.8 AND p2 > 0.8 THEN v + (v2 - v) * (0.8 - p) / (p2 - p) END),
  CASE WHEN min(p) > 0.8 THEN min(v) ELSE max(v) END), 6) AS weighted_quantile FROM b GROUP BY 1""")
def weighted_quantile_midpoint(spark, folder):
    return rounded(A.weighted_quantile(T.table(spark, folder, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", 0.8), "weighted_quantile")


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT event_type, median(ln(v)) AS m FROM d WHERE v > 0 GROUP BY 1)
SELECT event_type, count(*) AS n, round(stddev_pop(ln(v)), 6) AS log_std, round(median(abs(ln(v) - m)), 6) AS log_mad, round(max(v) / min(v), 6) AS max_over_min
FROM d JOIN m USING (event_type) WHERE v > 0 GROUP BY 1""")
def volatility_profile(spark, folder):
    daily = T.table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return rounded(A.volatility(daily, ["event_type"], "v"), "log_std", "log_mad", "max_over_min")


@query("""WITH m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1)
SELECT event_type, round(any_value(c), 6) AS centre, round(CASE WHEN 1.4826 * median(abs(value - c)) >= 1e-6 THEN 1.4826 * median(abs(value - c)) WHEN stddev_pop(value) >= 1e-6 THEN stddev_pop(value) ELSE 1.0 END, 6) AS scale
FROM events JOIN m USING (event_type) GROUP BY 1""")
def robust_scales(spark, folder):
    return rounded(A.robust_scale(T.table(spark, folder, "events"), ["event_type"], "value"), "centre", "scale")


@query("""WITH i AS (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY 1, 2)
SELECT event_type, round(median(m), 6) AS median_of_medians, count(*) AS groups FROM i GROUP BY 1""")
def two_stage_median(spark, folder):
    return rounded(A.staged_median(T.table(spark, folder, "events"), ["event_type", "user_id"], ["event_type"], "value"), "median_of_medians")


@query(f"""WITH {_ORDERS}, c AS (SELECT o_orderpriority, nation, avg(o_totalprice) AS m FROM orders_by_nation GROUP BY 1, 2)
SELECT o_orderpriority, round(avg(m), 4) AS equal_cluster_mean, count(*) AS clusters FROM c GROUP BY 1""")
def equal_cluster_means(spark, folder):
    return rounded(A.equal_cluster_mean(_orders(spark, folder), "nation", "o_totalprice", ["o_orderpriority"]), "equal_cluster_mean", digits=4)


@query("""WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_totalprice > 0)
SELECT o_orderpriority, round(exp(avg(ln(o_totalprice))), 4) AS trimmed_mean, count(*) AS kept FROM r WHERE r > greatest(1, floor(n * 0.1)) AND r <= n - greatest(1, floor(n * 0.1)) GROUP BY 1""")
def trimmed_log_means(spark, folder):
    return rounded(A.trimmed_log_mean(T.table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice"), "trimmed_mean", digits=4)


@query("""WITH s AS (SELECT s_nationkey, sum(ln(s_acctbal)) AS s, count(*) AS n, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT s_nationkey, n, round(exp(s / n), 4) AS center, round(exp((s - ln(hi)) / (n - 1)), 4) AS lowest, round(exp((s - ln(lo)) / (n - 1)), 4) AS highest FROM s WHERE n > 1""")
def jackknife_centres(spark, folder):
    return rounded(A.jackknife(T.table(spark, folder, "supplier"), ["s_nationkey"], "s_acctbal"), "center", "lowest", "highest", digits=4)


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(ln(x), ln(y)), 6) AS log_pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def pearson_spearman(spark, folder):
    return rounded(A.correlations(T.table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "pearson", "log_pearson", "spearman")


@query("""WITH s AS (SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2,
 regr_sxx(l_extendedprice, l_quantity) AS xx, regr_syy(l_extendedprice, l_quantity) AS yy, regr_sxy(l_extendedprice, l_quantity) AS xy FROM lineitem GROUP BY 1),
e AS (SELECT *, sqrt((yy - xy * xy / xx) / (n - 2) / xx) AS se FROM s)
SELECT l_returnflag, CAST(n AS BIGINT) AS n, round(b, 4) AS slope, round(a, 4) AS intercept, round(r2, 4) AS r2, round(se, 4) AS stderr, round(b / se, 4) AS t FROM e""")
def regression_suite(spark, folder):
    return rounded(A.regression(T.table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "slope", "intercept", "r2", "stderr", "t", digits=4)


@query("""WITH v AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS votes FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_returnflag) AS r FROM v) WHERE r = 1""")
def weighted_vote_label(spark, folder):
    return A.weighted_vote(T.table(spark, folder, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity")


@query("""SELECT p_brand, count(DISTINCT l_suppkey) AS entities, count(DISTINCT l_returnflag) AS groups, count(DISTINCT l_suppkey) >= 40 AND count(DISTINCT l_returnflag) >= 3 AS eligible
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def coverage_table(spark, folder):
    items = T.table(spark, folder, "lineitem").join(T.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.coverage(items, "p_brand", "l_suppkey", "l_returnflag", 40, 3)


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus_values, count(DISTINCT o_orderpriority) AS o_orderpriority_values FROM orders GROUP BY 1
HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def inconstant_identity(spark, folder):
    return A.inconstant(T.table(spark, folder, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("SELECT user_id, event_type, max(value) AS value, count(*) AS collapsed FROM events GROUP BY 1, 2")
def collapsed_best(spark, folder):
    return A.collapse(T.table(spark, folder, "events"), ["user_id", "event_type"], {"value": "max"})


@query("""WITH d AS (SELECT DISTINCT o_orderpriority, sha256(CAST(o_orderkey AS VARCHAR)) AS d FROM orders)
SELECT o_orderpriority, count(*) AS items, CAST(sum(CAST('0x' || substr(d, 1, 8) AS UBIGINT)) AS VARCHAR) AS digest_a, CAST(sum(CAST('0x' || substr(d, 9, 8) AS UBIGINT)) AS VARCHAR) AS digest_b FROM d GROUP BY 1""")
def set_digests(spark, folder):
    out = A.set_digest(T.table(spark, folder, "orders"), ["o_orderpriority"], "o_orderkey")
    return out.withColumns({c: F.col(c).cast("string") for c in ("digest_a", "digest_b")})


@query("SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN abs(l_discount) < abs(l_tax) THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM lineitem GROUP BY 1")
def win_rates(spark, folder):
    return rounded(A.win_rate(T.table(spark, folder, "lineitem"), ["l_returnflag"], "l_discount", "l_tax"), "win_rate")


@query("""SELECT p_partkey, 'p_retailprice' AS metric, p_retailprice AS value FROM part WHERE p_retailprice IS NOT NULL
UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE) FROM part WHERE p_size IS NOT NULL""")
def unpivot_long(spark, folder):
    parts = T.table(spark, folder, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return A.long_form(parts, ["p_partkey"], ["p_retailprice", "p_size"])


@query("""SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY 1""")
def pivot_max(spark, folder):
    wide = T.table(spark, folder, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return wide.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("""WITH b AS (SELECT l_suppkey, l_returnflag, l_linestatus, ln(l_extendedprice) AS l FROM lineitem WHERE l_extendedprice > 0),
f AS (SELECT l_linestatus, l_returnflag, median(l) AS m, count(*) AS n FROM b GROUP BY 1, 2), c AS (SELECT l_linestatus, median(l) AS m, count(*) AS n FROM b GROUP BY 1),
g AS (SELECT l_returnflag, median(l) AS m, count(*) AS n FROM b GROUP BY 1), a AS (SELECT median(l) AS m FROM b)
SELECT b.l_suppkey, round(exp(median(b.l - CASE WHEN f.n >= 500 THEN f.m WHEN c.n >= 500 THEN c.m WHEN g.n >= 500 THEN g.m ELSE a.m END)), 6) AS "index", count(*) AS n
FROM b JOIN f USING (l_linestatus, l_returnflag) JOIN c USING (l_linestatus) JOIN g USING (l_returnflag) CROSS JOIN a GROUP BY 1""")
def hierarchical_normalised_index(spark, folder):
    return rounded(A.normalised_index(T.table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", "l_suppkey", "l_extendedprice", 500), "index")


# ---------------------------------------------------------------- windows


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_orders(spark, folder):
    return W.top_per_group(T.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"], 3)


@query("""WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS position, first_value(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS best FROM part)
SELECT p_brand, p_partkey, p_size, CAST(position AS INTEGER) AS position, CASE WHEN position = 1 THEN 'chosen' WHEN p_size = best THEN 'tie' ELSE 'lower score' END AS reason FROM r""")
def top1_with_exclusion_reason(spark, folder):
    return W.top_with_reason(T.table(spark, folder, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], ["-p_size", "p_partkey"], "p_size")


@query("""SELECT o_custkey, day, o_orderkey, e FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, abs(e) DESC, o_orderkey) AS r
 FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice - 150000.0 AS e FROM orders)) WHERE r = 1""")
def latest_worst_tie(spark, folder):
    rows = T.table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", (F.col("o_totalprice") - 150000.0).alias("e"))
    return W.latest_with_worst_tie(rows, ["o_custkey"], "day", "e", "o_orderkey")


@query(f"""WITH {_ORDERS}, d AS (SELECT nation, day, max(o_totalprice) AS o_totalprice FROM orders_by_nation GROUP BY 1, 2),
b AS (SELECT *, max(o_totalprice) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d)
SELECT nation, day, o_totalprice FROM b WHERE b IS NULL OR o_totalprice > b""")
def running_record_frontier(spark, folder):
    return W.running_records(_orders(spark, folder), ["nation"], "day", "o_totalprice")


@query(f"""WITH {_ORDERS}, r AS (SELECT nation, day, CAST(floor(o_totalprice / 50000) AS BIGINT) AS bucket FROM orders_by_nation),
c AS (SELECT nation, day, bucket, count(*) AS n FROM r GROUP BY 1, 2, 3),
p AS (SELECT c.nation, c.day, c.bucket, any_value(c.n) AS n, sum(e.n) AS earlier, sum(CASE WHEN e.bucket <= c.bucket THEN e.n ELSE 0 END) AS low FROM c JOIN c e ON e.nation = c.nation AND e.day < c.day GROUP BY 1, 2, 3)
SELECT nation, day, bucket, CAST(n AS BIGINT) AS "rows", CAST(earlier AS BIGINT) AS earlier, round(low / earlier, 6) AS share FROM p""")
def prior_percentile_rank(spark, folder):
    rows = _orders(spark, folder).withColumn("bucket", F.floor(F.col("o_totalprice") / 50000))
    return rounded(prefix_ranks(rows, ["nation"], "day", "bucket"), "share")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS step, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS from_previous, round(o_totalprice - first_value(o_totalprice) OVER w, 4) AS from_first
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def chain_deltas(spark, folder):
    out = W.chain_deltas(T.table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return rounded(out.select("o_custkey", "o_orderkey", "step", "from_previous", "from_first"), "from_previous", "from_first", digits=4)


_LEVELS = "SELECT event_id, user_id, ts, CAST(floor(value / 40) AS BIGINT) AS level FROM events"


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return T.table(spark, folder, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") / 40).alias("level"))


@query(f"""WITH l AS ({_LEVELS}), p AS (SELECT *, lag(level) OVER w AS p, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, ts, level FROM p WHERE n = 1 OR level IS DISTINCT FROM p""")
def change_points(spark, folder):
    return W.change_points(_levels(spark, folder), ["user_id"], ["ts", "event_id"], "level")


@query(f"""WITH l AS ({_LEVELS}), d AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(level, (ts, event_id)) AS value FROM l GROUP BY 1, 2),
s AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1)
SELECT s.user_id, s.day, d.day AS changed_on, d.value FROM s ASOF JOIN d ON s.user_id = d.user_id AND s.day >= d.day""")
def changepoint_forward_fill(spark, folder):
    return W.daily_forward_fill(_levels(spark, folder), ["user_id"], "ts", "event_id", "level")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2), a AS (SELECT *, date_diff('day', min(day) OVER (PARTITION BY user_id), day) AS age FROM d)
SELECT user_id, count(*) AS days, round(CASE WHEN count(*) FILTER (age < 3) = 3 THEN avg(v) FILTER (age < 3) END, 4) AS mean_3d, round(CASE WHEN count(*) FILTER (age < 7) = 7 THEN avg(v) FILTER (age < 7) END, 4) AS mean_7d FROM a GROUP BY 1""")
def lookahead_means(spark, folder):
    daily = T.table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return rounded(W.lookahead_means(daily, ["user_id"], "v", [3, 7]), "mean_3d", "mean_7d", digits=4)


@query("""SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_seen_events(spark, folder):
    return W.first_seen(T.table(spark, folder, "events").drop("props"), ["user_id", "event_type"], "ts", "event_id")


@query("""WITH s AS (SELECT DISTINCT date_trunc('week', ts) AS snap FROM events), e AS (SELECT snap, lag(snap) OVER (ORDER BY snap) AS prev FROM s)
SELECT event_id, prev AS previous_snapshot, snap AS observed_snapshot FROM events LEFT JOIN e ON ts <= snap AND (prev IS NULL OR ts > prev)""")
def snapshot_interval(spark, folder):
    events = T.table(spark, folder, "events").select("event_id", "ts")
    return W.interval_of(events, events.select(F.date_trunc("week", "ts").alias("snap")), "ts", "snap").select("event_id", "previous_snapshot", "observed_snapshot")


@query("""WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, count(*) AS "rows", count(*) FILTER (value < p) AS steps_down, count(*) FILTER (value = p) AS repeats FROM p GROUP BY 1""")
def monotone_check(spark, folder):
    return W.monotone_report(T.table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("""WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_quantity, n AS "rows", round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM c""")
def empirical_distribution(spark, folder):
    return rounded(W.ecdf(T.table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity"), "share")


@query(f"""WITH {_ORDERS}, r AS (SELECT nation, abs(y - 11.5) AS e, row_number() OVER (PARTITION BY nation ORDER BY abs(y - 11.5), o_orderkey) AS r FROM orders_by_nation),
s AS (SELECT nation, CAST(max(r) AS BIGINT) AS n, CAST(ceil((max(r) + 1) * 0.9) AS BIGINT) AS rank FROM r GROUP BY 1)
SELECT s.nation, s.n, s.rank, round(r.e, 6) AS order_statistic FROM s LEFT JOIN r ON r.nation = s.nation AND r.r = s.rank""")
def order_statistic_factor(spark, folder):
    errors = _orders(spark, folder).withColumn("e", F.abs(F.col("y") - 11.5))
    return rounded(W.order_statistic(errors, ["nation"], "e", 0.9), "order_statistic")


@query("""SELECT p_brand, p_partkey, 'part-' || lpad(CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS VARCHAR), 6, '0') AS id FROM part""")
def numbered_ids(spark, folder):
    return W.numbered(T.table(spark, folder, "part"), ["p_brand"], ["-p_retailprice", "p_partkey"], "part-").select("p_brand", "p_partkey", "id")


# ---------------------------------------------------------------- matching and sets


@query("""WITH k AS (SELECT p_name AS k, count(*) AS n, min(p_partkey) AS p FROM part GROUP BY 1)
SELECT s_suppkey, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN p END AS p_partkey, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status
FROM supplier LEFT JOIN k ON k.k = (SELECT p_name FROM part WHERE p_partkey = s_suppkey)""")
def unique_key_match(spark, folder):
    parts, suppliers = T.table(spark, folder, "part"), T.table(spark, folder, "supplier")
    named = suppliers.join(parts.select(F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("name")), "s_suppkey", "left")
    return M.join_unique_keys(named, parts, F.col("name"), F.col("p_name"), ["p_partkey"]).select("s_suppkey", "candidates", "p_partkey", "status")


@query("""WITH c AS (SELECT c_custkey, s_suppkey, CAST(floor(c_acctbal / 2500) <> floor(s_acctbal / 2500) AS INTEGER) + CAST(c_custkey % 7 <> s_suppkey % 7 AS INTEGER) AS d FROM customer JOIN supplier ON s_nationkey = c_nationkey),
b AS (SELECT c_custkey, min(d) AS d FROM c GROUP BY 1), t AS (SELECT c.c_custkey, c.d, count(*) AS n, min(s_suppkey) AS s FROM c JOIN b ON b.c_custkey = c.c_custkey AND b.d = c.d GROUP BY 1, 2)
SELECT customer.c_custkey, CASE WHEN n = 1 THEN s END AS s_suppkey, d AS disagreement, coalesce(n, 0) AS tied FROM customer LEFT JOIN t USING (c_custkey)""")
def min_disagreement_match(spark, folder):
    left = T.table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 2500).alias("a1"), (F.col("c_custkey") % 7).alias("a2"))
    right = T.table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 2500).alias("b1"), (F.col("s_suppkey") % 7).alias("b2"))
    return M.least_disagreement(left, right, ["nation"], [("a1", "b1"), ("a2", "b2")], "c_custkey", "s_suppkey")


@query("""WITH a AS (SELECT p_name AS name, min(p_partkey) AS target FROM part GROUP BY 1 HAVING count(*) = 1), b AS (SELECT p_name AS name, min(p_partkey) AS target FROM part WHERE p_size > 25 GROUP BY 1),
n AS (SELECT DISTINCT p_name AS name FROM part)
SELECT name, coalesce(a.target, b.target) AS target, CASE WHEN a.target IS NOT NULL THEN 'unique name' WHEN b.target IS NOT NULL THEN 'large part' ELSE 'unmatched' END AS method FROM n LEFT JOIN a USING (name) LEFT JOIN b USING (name)""")
def cascaded_match(spark, folder):
    parts = T.table(spark, folder, "part").withColumn("name", F.col("p_name"))
    unique = parts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("target")).where("n = 1").drop("n")
    large = parts.where("p_size > 25").groupBy("name").agg(F.min("p_partkey").alias("target"))
    return M.cascade(parts.select("name").distinct(), [("unique name", unique), ("large part", large)], "name", "target")


@query("""SELECT a AS o_orderkey, b AS matched, score FROM (SELECT l.o_orderkey AS a, r.o_orderkey AS b, round(abs(l.o_totalprice - r.o_totalprice), 4) AS score, row_number() OVER (PARTITION BY l.o_orderkey ORDER BY round(abs(l.o_totalprice - r.o_totalprice), 4), r.o_orderkey) AS k
 FROM orders l JOIN orders r ON l.o_custkey = r.o_custkey AND l.o_orderkey <> r.o_orderkey AND abs(date_diff('day', CAST(l.o_orderdate AS DATE), CAST(r.o_orderdate AS DATE))) <= 120) WHERE k = 1""")
def scored_range_match(spark, folder):
    left = T.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    right = left.withColumnsRenamed({"o_orderkey": "matched", "o_totalprice": "other_price", "day": "other_day"})
    near = (F.col("o_orderkey") != F.col("matched")) & (F.abs(F.datediff("day", "other_day")) <= 120)
    score = F.round(F.abs(F.col("o_totalprice") - F.col("other_price")), 4)
    return M.range_match(left, right, ["o_custkey"], near, score, [F.asc("score"), F.asc("matched")], "o_orderkey").select("o_orderkey", "matched", "score")


@query("""SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 4 WHEN 7 THEN 0 ELSE n_regionkey END AS n_regionkey, n_nationkey IN (3, 7) AS overridden FROM nation""")
def override_update(spark, folder):
    nations = T.table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    fixes = nations.where("n_nationkey in (3, 7)").select("n_nationkey", F.col("n_regionkey").alias("expected"), F.when(F.col("n_nationkey") == 3, 4).otherwise(0).alias("replacement"))
    return M.apply_overrides(nations, fixes, "n_nationkey", "n_regionkey")


_LEDGER = "SELECT event_id, user_id, value, CASE WHEN event_id % 3 = 0 THEN lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS supersedes FROM events"


@query(f"WITH l AS ({_LEDGER}) SELECT event_id, user_id, value, supersedes FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.supersedes = l.event_id)")
def supersession_active_view(spark, folder):
    chain = W.Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    ledger = T.table(spark, folder, "events").withColumn("supersedes", F.when(F.col("event_id") % 3 == 0, F.lag("event_id").over(chain)))
    return M.active_rows(ledger.select("event_id", "user_id", "value", "supersedes"), "event_id", "supersedes")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END, ts DESC, event_id) AS r FROM events WHERE event_type IN ('purchase', 'click', 'view')) WHERE r = 1""")
def source_priority(spark, folder):
    return M.with_priority(T.table(spark, folder, "events"), ["user_id"], "event_type", ["purchase", "click", "view"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


def _month(spark: SparkSession, folder: str, month: str) -> DataFrame:
    rows = T.table(spark, folder, "orders").where(F.date_format("o_orderdate", "yyyy-MM") == month)
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderpriority").alias("priority"))


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-01' GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-02' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN a.o_custkey IS NULL OR b.o_custkey IS NULL THEN '' ELSE concat_ws('|', CASE WHEN a.n <> b.n THEN 'orders' END, CASE WHEN a.p <> b.p THEN 'priority' END) END AS fields
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.n <> b.n OR a.p <> b.p""")
def snapshot_diff(spark, folder):
    return M.snapshot_diff(_month(spark, folder, "1996-01"), _month(spark, folder, "1996-02"), "o_custkey", ["orders", "priority"])


@query("""WITH a AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2, 3), b AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, l_quantity, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows FROM a FULL JOIN b USING (l_returnflag, l_linestatus, l_quantity) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_reconcile(spark, folder):
    items = T.table(spark, folder, "lineitem")
    return M.multiset_difference(items.where("l_linenumber % 2 = 0"), items.where("l_linenumber % 2 = 1"), ["l_returnflag", "l_linestatus", "l_quantity"])


@query("""SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))""")
def skyline_parts(spark, folder):
    return M.skyline(T.table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_references(spark, folder):
    urgent = T.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return M.missing_keys(T.table(spark, folder, "customer").select("c_custkey", "c_name"), urgent, "c_custkey", "o_custkey")


@query("""SELECT c_nationkey AS nation, 'customer' AS origin, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60
UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 60) GROUP BY 1""")
def union_precedence(spark, folder):
    side = lambda name, key: T.table(spark, folder, name).groupBy(F.col(key).alias("nation")).agg(F.lit(name).alias("origin"), F.count(F.lit(1)).alias("n"))
    return M.union_with_precedence(side("customer", "c_nationkey").where("n > 60"), side("supplier", "s_nationkey"), ["nation"])


@query("""WITH p AS (SELECT p_partkey, trim(unnest(string_split(p_name || '|' || p_brand || '| |' || p_type, '|'))) AS alias FROM part), t AS (SELECT p_brand AS alias, min(p_partkey) AS first_part FROM part GROUP BY 1)
SELECT p_partkey, count(*) AS aliases, count(first_part) AS found, min(first_part) AS first_part FROM p LEFT JOIN t USING (alias) WHERE alias <> '' GROUP BY 1""")
def alias_expansion(spark, folder):
    parts = T.table(spark, folder, "part")
    listed = parts.withColumn("aliases", F.concat_ws("|", "p_name", "p_brand", F.lit(" "), "p_type"))
    brands = parts.groupBy(F.col("p_brand").alias("alias")).agg(F.min("p_partkey").alias("first_part"))
    return M.alias_lookup(listed, "aliases", brands, "alias", "first_part", ["p_partkey"])


@query("SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL")
def all_present_rows(spark, folder):
    joined = T.table(spark, folder, "documents").join(T.table(spark, folder, "labels"), "doc_id")
    return M.all_present(joined, ["quality", "toxic", "lang"]).select("doc_id", "quality", "toxic")


@query("""WITH a AS (SELECT n_regionkey AS region FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT r_regionkey AS region FROM region UNION ALL SELECT 99)
SELECT region, 'left' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT region, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def set_equality(spark, folder):
    nations, regions = T.table(spark, folder, "nation"), T.table(spark, folder, "region")
    held = regions.select(F.col("r_regionkey").cast("int").alias("region"))
    return M.same_rows(nations.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("region")), held.unionByName(held.sparkSession.createDataFrame([(99,)], "region int")))


@query("""SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey""")
def guarded_lookup(spark, folder):
    customers = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return M.unique_join(T.table(spark, folder, "orders"), customers, ["o_custkey"]).select("o_orderkey", "c_name", "o_totalprice")


# ---------------------------------------------------------------- scalars


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS name_key, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS name_slug,
 CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'copper') THEN 'copper' ELSE 'other' END AS material,
 CAST(p_size * CASE p_partkey % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1000000.0 ELSE 1.0 END AS DOUBLE) AS parsed, p_partkey % 3 = 0 AS floored, p_brand AS key_head, 'standard' AS key_tier FROM part""")
def text_scalars(spark, folder):
    parts = T.table(spark, folder, "part")
    unit = F.element_at(F.array(F.lit("k"), F.lit("M"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "< ").otherwise(" "), F.col("p_size").cast("string"), unit)
    return parts.select(
        "p_partkey", S.normal_key(F.col("p_name")).alias("name_key"), S.slug(F.col("p_name")).alias("name_slug"), S.classify(F.col("p_type"), [("steel", "steel"), ("copper", "copper")], "other").alias("material"),
        S.magnitude(text).alias("parsed"), S.is_floor(text).alias("floored"), S.key_part(F.concat("p_brand", F.lit("::")), 1, "x").alias("key_head"), S.key_part(F.concat("p_brand", F.lit("::")), 2, "standard").alias("key_tier"),
    )


@query("""SELECT o_orderkey, round(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 365.25, 6) AS years,
 round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / date_diff('day', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1)), 6) AS decimal_year,
 CAST(o_orderdate AS DATE) AS from_compact, CAST(o_orderdate AS DATE) AS from_epoch FROM orders""")
def date_scalars(spark, folder):
    day = F.to_date("o_orderdate")
    return T.table(spark, folder, "orders").select(
        "o_orderkey", F.round(S.years_since(day, "1995-01-01"), 6).alias("years"), F.round(S.decimal_year(day), 6).alias("decimal_year"),
        S.compact_date(F.date_format("o_orderdate", "yyyyMMddHHmmss")).alias("from_compact"), S.epoch_date(F.unix_timestamp("o_orderdate")).alias("from_epoch"),
    )


@query("""SELECT p_partkey, round(ln(greatest(0.001, least(0.999, p_size / 50.0)) / (1 - greatest(0.001, least(0.999, p_size / 50.0)))), 6) AS logit, greatest(-1.0, least(1.0, (p_retailprice - 1400) / 300)) AS clipped,
 round(sqrt(p_retailprice * p_size), 6) AS midpoint, round(greatest(p_retailprice / 1400, 1400 / p_retailprice), 6) AS factor, abs(p_retailprice - 1400) <= 100 AS near FROM part""")
def number_scalars(spark, folder):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return T.table(spark, folder, "part").select(
        "p_partkey", F.round(S.clipped_logit(size / 50.0), 6).alias("logit"), S.clip((price - 1400) / 300, -1.0, 1.0).alias("clipped"), F.round(S.geometric_midpoint(price, size), 6).alias("midpoint"),
        F.round(S.multiplicative_error(price, F.lit(1400.0)), 6).alias("factor"), S.near(price, F.lit(1400.0), 100.0).alias("near"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END AS number, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 0 END AS tri, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name END AS label FROM part""")
def cast_scalars(spark, folder):
    parts, pick = T.table(spark, folder, "part"), F.col("p_partkey") % 4
    raw = F.when(pick == 0, F.element_at(F.array(*map(F.lit, ("", " ", "NaN", "n/a", "-Infinity"))), (F.col("p_partkey") % 5 + 1).cast("int"))).otherwise(F.col("p_retailprice").cast("string"))
    word = F.when(pick == 1, " Yes").when(pick == 2, "FALSE").when(pick == 3, "maybe")
    return parts.select("p_partkey", S.finite_number(raw).alias("number"), S.tri_state(word).alias("tri"), S.first_non_blank(F.when(pick == 0, "  ").otherwise(F.col("p_name")), F.col("p_brand")).alias("label"))


@query("SELECT event_id, 'k' AS leaf, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value_text, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_leaf_measurements(spark, folder):
    return T.json_leaves(T.table(spark, folder, "events"), ["event_id"], "props")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS BIGINT) AS links, regexp_matches(html, '(?i)<script') AS scripted FROM pages""")
def html_embedded_extract(spark, folder):
    return T.embedded(T.table(spark, folder, "pages"), ["page_id"], "html")


@query("""SELECT doc_id, sha256(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || coalesce(lang, chr(0)) || chr(31) || coalesce(text, chr(0))) AS digest FROM documents""")
def content_digest(spark, folder):
    return T.table(spark, folder, "documents").select("doc_id", T.row_digest(F.col("doc_id"), F.col("lang"), F.col("text")).alias("digest"))


@query("""SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS representative, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_collapse(spark, folder):
    docs = T.table(spark, folder, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return docs.agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


# ---------------------------------------------------------------- evaluations

_FORWARD = f"""WITH {_ORDERS}, t AS (SELECT DISTINCT nation, day FROM orders_by_nation),
c AS (SELECT nation, day, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM orders_by_nation GROUP BY 1, 2),
d AS (SELECT day, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM c GROUP BY 1),
a AS (SELECT day, sum(n) OVER w AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT nation, day, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(x) OVER w, 0) AS x, coalesce(sum(y) OVER w, 0) AS y, coalesce(sum(xx) OVER w, 0) AS xx, coalesce(sum(xy) OVER w, 0) AS xy FROM c WINDOW w AS (PARTITION BY nation ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT g.nation, g.day, a.n - g.n AS n, a.x - g.x AS x, a.y - g.y AS y, a.xx - g.xx AS xx, a.xy - g.xy AS xy FROM g JOIN a USING (day)),
f AS (SELECT nation, day, n, (n * xy - x * y) / (n * xx - x * x) AS b, x, y FROM s WHERE n >= 30 AND n * xx - x * x > 1e-9),
e AS (SELECT o.*, (f.y - f.b * f.x) / f.n + f.b * o.x - o.y AS error FROM orders_by_nation o JOIN f ON f.nation = o.nation AND f.day = o.day)"""


def _forward(spark: SparkSession, folder: str) -> DataFrame:
    return regression.walk_forward(_orders(spark, folder), "nation", "day", "x", "y", 30)


@query(f"{_FORWARD} SELECT nation, count(*) AS tests, round(avg(abs(error)), 6) AS mean_abs_error, round(exp(avg(error)), 6) AS bias_factor FROM e GROUP BY 1")
def walkforward_holdout(spark, folder):
    out = _forward(spark, folder).groupBy("nation").agg(F.count(F.lit(1)).alias("tests"), F.avg(F.abs("error")).alias("mean_abs_error"), F.exp(F.avg("error")).alias("bias_factor"))
    return rounded(out, "mean_abs_error", "bias_factor")


@query("""WITH c AS (SELECT l_returnflag || l_linestatus AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT DISTINCT g FROM c),
f AS (SELECT s.g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s JOIN c ON c.g <> s.g GROUP BY 1)
SELECT c.g AS cell, count(*) AS n, round(any_value(b), 4) AS slope, round(avg(abs(a + b * x - y)), 4) AS mean_abs_error FROM c JOIN f USING (g) GROUP BY 1""")
def leave_one_group_out(spark, folder):
    items = T.table(spark, folder, "lineitem").withColumn("cell", F.concat("l_returnflag", "l_linestatus"))
    return rounded(regression.leave_one_group_out(items, "cell", "l_quantity", "l_extendedprice"), "slope", "mean_abs_error", digits=4)


@query("""WITH m AS (SELECT l_suppkey, l_quantity - avg(l_quantity) OVER w AS x, l_extendedprice - avg(l_extendedprice) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
SELECT count(DISTINCT l_suppkey) AS groups, count(*) AS n, round(sum(x * y) / sum(x * x), 4) AS slope FROM m""")
def fixed_effect_slope(spark, folder):
    return rounded(regression.within_group_slope(T.table(spark, folder, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice"), "slope", digits=4)


@query("""SELECT p_partkey, round(CASE WHEN p_size > 10 THEN exp(0.6 * ln(p_retailprice) + 0.4 * ln(p_size * 40)) ELSE p_retailprice END, 4) AS blended FROM part""")
def blend_60_40(spark, folder):
    parts = T.table(spark, folder, "part")
    second = F.when(F.col("p_size") > 10, F.col("p_size") * 40.0)
    return rounded(parts.select("p_partkey", ensembles.log_blend([F.col("p_retailprice"), second], [0.6, 0.4]).alias("blended")), "blended", digits=4)


@query("""WITH r AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS estimate, CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.3 ELSE 0.2 END AS weight FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2),
s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY l_suppkey) AS live FROM r)
SELECT l_suppkey, l_returnflag, round(live, 6) AS live_weight, round(exp(sum(live * ln(estimate)) OVER (PARTITION BY l_suppkey)), 4) AS blend FROM s""")
def missing_factor_reallocation(spark, folder):
    weight = F.when(F.col("l_returnflag") == "A", 0.5).when(F.col("l_returnflag") == "N", 0.3).otherwise(0.2)
    factors = T.table(spark, folder, "lineitem").where("l_quantity > 45").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("estimate")).withColumn("weight", weight)
    out = ensembles.reallocated_weights(factors, ["l_suppkey"], "l_returnflag", "estimate", "weight")
    return rounded(rounded(out, "live_weight"), "blend", digits=4)


_PANEL = "SELECT ln(p_retailprice) AS y, 7.0 + p_size / 100.0 AS a, 7.5 - p_size / 200.0 AS b, 7.2 + CAST(p_partkey % 10 AS DOUBLE) / 50 AS c FROM part"


@query(f"""WITH p AS ({_PANEL}), g AS (SELECT i.i AS w0, j.j AS w1, 20 - i.i - j.j AS w2 FROM range(21) i(i), range(21) j(j) WHERE i.i + j.j <= 20)
SELECT w0, w1, w2, round(avg(pow((w0 * a + w1 * b + w2 * c) / 20.0 - y, 2)), 6) AS mse FROM p, g GROUP BY 1, 2, 3""")
def simplex_weights(spark, folder):
    size = F.col("p_size")
    panel = T.table(spark, folder, "part").select(F.log("p_retailprice").alias("y"), (7.0 + size / 100.0).alias("a"), (7.5 - size / 200.0).alias("b"), (7.2 + (F.col("p_partkey") % 10).cast("double") / 50).alias("c"))
    return rounded(ensembles.simplex(panel, ["a", "b", "c"], "y", 20), "mse")


_DRAW = "CAST('0x' || substr(md5('{seed}|' || {a} || '|' || {b}), 1, 8) AS UBIGINT)"


@query(f"""WITH {_ORDERS}, c AS (SELECT nation, sum(y - 11.5) AS s, count(*) AS n, row_number() OVER (ORDER BY nation) - 1 AS k FROM orders_by_nation GROUP BY 1), m AS (SELECT count(*) AS m FROM c),
d AS (SELECT b.d AS draw, {_DRAW.format(seed=17, a="CAST(b.d AS VARCHAR)", b="CAST(c.k AS VARCHAR)")} % m AS k FROM range(400) b(d), c, m),
v AS (SELECT draw, avg(s / n) AS v FROM d JOIN c USING (k) GROUP BY 1)
SELECT (SELECT round(avg(s / n), 6) FROM c) AS observed, (SELECT count(*) FROM c) AS clusters, round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high, round(avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END), 6) AS share_below_zero FROM v""")
def cluster_bootstrap_ci(spark, folder):
    rows = _orders(spark, folder).withColumn("v", F.col("y") - 11.5)
    return rounded(resampling.cluster_bootstrap(rows, "nation", "v", 400, 17), "observed", "low", "high", "share_below_zero")


@query(f"""WITH {_ORDERS}, c AS (SELECT o_orderpriority AS test, nation, avg(y - 11.5) AS v FROM orders_by_nation GROUP BY 1, 2),
own AS (SELECT test, count(*) AS clusters, abs(avg(v)) / greatest(stddev_samp(v) / sqrt(count(*)), 1e-12) AS t FROM c GROUP BY 1),
g AS (SELECT f.f AS flip, nation, CASE WHEN {_DRAW.format(seed=23, a="CAST(f.f AS VARCHAR)", b="CAST(nation AS VARCHAR)")} % 2 = 0 THEN 1.0 ELSE -1.0 END AS g FROM range(200) f(f), (SELECT DISTINCT nation FROM c)),
s AS (SELECT flip, test, abs(avg(v * g)) / greatest(stddev_samp(v * g) / sqrt(count(*)), 1e-12) AS t FROM c JOIN g USING (nation) GROUP BY 1, 2), top AS (SELECT flip, max(t) AS t FROM s GROUP BY 1)
SELECT own.test AS o_orderpriority, own.clusters, round(own.t, 4) AS statistic, round((count(*) FILTER (top.t >= own.t - 1e-9) + 1) / 201.0, 6) AS p_value FROM own, top GROUP BY 1, 2, own.t""")
def max_t_signflip(spark, folder):
    rows = _orders(spark, folder).withColumn("v", F.col("y") - 11.5)
    return rounded(rounded(resampling.max_t_sign_flips(rows, "o_orderpriority", "nation", "v", 200, 23), "statistic", digits=4), "p_value")


@query("""WITH m AS (SELECT o_orderpriority, greatest(median(o_totalprice), 250000.0) AS lim FROM orders GROUP BY 1), s AS (SELECT unnest([0.0, 0.5, 1.0]) AS strength),
p AS (SELECT o.o_orderpriority, strength, CASE WHEN o_totalprice > lim THEN exp(ln(o_totalprice) + strength * (ln(lim) - ln(o_totalprice))) ELSE o_totalprice END AS p FROM orders o JOIN m USING (o_orderpriority), s)
SELECT o_orderpriority, CAST(strength AS DOUBLE) AS strength, round(median(p), 4) AS median, round(quantile_cont(p, 0.9), 4) AS p90, round(avg(p), 4) AS mean FROM p GROUP BY 1, 2""")
def winsorised_upper_tail(spark, folder):
    return rounded(ensembles.winsorised_tail(T.table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice", 250000.0, [0.0, 0.5, 1.0]), "median", "p90", "mean", digits=4)


@query(f"""WITH {_ORDERS}, c AS (SELECT nation, day, count(*) AS tests, count(*) FILTER (abs(y - 11.5) <= 0.5) AS hits FROM orders_by_nation GROUP BY 1, 2),
p AS (SELECT a.nation, a.day, any_value(a.tests) AS tests, any_value(a.hits) AS hits, sum(b.tests) AS earlier, sum(b.hits) AS eh FROM c a JOIN c b ON b.day < a.day AND b.nation <> a.nation GROUP BY 1, 2)
SELECT nation, day, CAST(tests AS BIGINT) AS tests, CAST(hits AS BIGINT) AS hits, CAST(earlier AS BIGINT) AS earlier, round(eh / earlier, 6) AS earlier_rate FROM p WHERE earlier >= 100""")
def sequential_coverage(spark, folder):
    rows = _orders(spark, folder).withColumn("e", F.col("y") - 11.5)
    return rounded(ensembles.sequential_coverage(rows, "nation", "day", "e", 0.5, 100), "earlier_rate")


@query("""WITH m AS (SELECT p_brand, count(*) AS n, avg(p_size) AS size, max(p_retailprice) AS price FROM part GROUP BY 1)
SELECT p_brand, n >= 70 AS enough, size > 25 AS large, price > 1500 AS dear, n >= 70 AND size > 25 AND price > 1500 AS promoted, CASE WHEN n >= 70 AND size > 25 AND price > 1500 THEN 1.0 ELSE 0.0 END::DOUBLE AS live_weight FROM m""")
def promotion_gate(spark, folder):
    facts = T.table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("size"), F.max("p_retailprice").alias("price"))
    return ensembles.promotion_gate(facts, ["p_brand"], {"enough": F.col("n") >= 70, "large": F.col("size") > 25, "dear": F.col("price") > 1500})


def _huber_sql(turns: int, c: float = 1.345) -> str:
    """Huber's reweighted lines, turn by turn: a fit, its residuals, their median, and the next weights."""
    out = ["r0 AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y, CAST(1 AS DOUBLE) AS w FROM lineitem)"]
    for k in range(turns):
        out.append(f"s{k} AS (SELECT g, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, count(*) AS n FROM r{k} GROUP BY g)")
        out.append(f"f{k} AS (SELECT g, n, (xy - x * y / w) / (xx - x * x / w) AS b, (y - (xy - x * y / w) / (xx - x * x / w) * x) / w AS a FROM s{k})")
        out.append(f"e{k} AS (SELECT g, x, y, abs(y - a - b * x) AS e FROM r{k} JOIN f{k} USING (g))")
        out.append(f"r{k + 1} AS (SELECT g, x, y, least(1.0, {c} * greatest(1.4826 * m, 1e-9) / greatest(e, 1e-12)) AS w FROM e{k} JOIN (SELECT g, median(e) AS m FROM e{k} GROUP BY g) USING (g))")
    return f"WITH {', '.join(out)} SELECT g AS l_returnflag, n, round(b, 3) AS slope, round(a, 3) AS intercept FROM f{turns - 1}"


@query(_huber_sql(12))
def huber_line_fit(spark, folder):
    fits = linear.huber_fit(T.table(spark, folder, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice")
    return rounded(fits.select("l_returnflag", "n", F.col("b1").alias("slope"), F.col("b0").alias("intercept")), "slope", "intercept", digits=3)


@query()
def student_t_p(spark, folder):
    """No SQL: the incomplete beta function. Tests hold it against tabled values."""
    fits = A.regression(T.table(spark, folder, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return fits.select("l_suppkey", F.round(S.student_t_p(F.col("t"), F.col("n").cast("double") - 2), 9).alias("p"))


@query()
def similarity_ratio(spark, folder):
    """No SQL: matching blocks. Tests hold it against the standard library."""
    parts = T.table(spark, folder, "part")
    return parts.select("p_partkey", F.round(S.similarity_ratio(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


# ---------------------------------------------------------------- events by time


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_totals(spark, folder):
    return rounded(streams.windowed_totals(T.table(spark, folder, "events"), "1 day", "1 day"), "total", digits=4)


@query("""WITH p AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM p)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, s""")
def user_sessions(spark, folder):
    return streams.sessions(T.table(spark, folder, "events"), "6 hours", "1 day")


from tidemark import model_queries as _models, pair_queries as _pairs, shape_queries as _shapes  # noqa: E402, F401  register their queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
