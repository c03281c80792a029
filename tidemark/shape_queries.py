"""Queries of filters, projections, joins of panels and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A
from tidemark.operators import matching as M
from tidemark.operators import panels as P
from tidemark.operators import shaping as H
from tidemark.plans.linear import near_best
from tidemark.registry import ORDERS, orders_panel, query, rounded
from tidemark.sources import documents as D
from tidemark.sources import tables as T

# ---------------------------------------------------------------- predicates and projections


@query("SELECT p_partkey, CASE WHEN p_retailprice - 1400 > 0 THEN p_retailprice - 1400 END AS positive FROM part")
def positive_numbers(spark, folder):
    return T.table(spark, folder, "part").select("p_partkey", S.positive_number((F.col("p_retailprice") - 1400).cast("string")).alias("positive"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority <> '5-LOW'")
def eligible_orders(spark, folder):
    rules = [F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.col("o_orderdate") >= "1996-01-01", F.col("o_orderpriority") != "5-LOW"]
    return H.eligible(T.table(spark, folder, "orders"), rules).select("o_orderkey", "o_totalprice")


@query("""SELECT specification, count(*) AS rows, round(avg(p_retailprice), 4) AS mean FROM (SELECT 'all' AS specification, * FROM part UNION ALL SELECT 'large', * FROM part WHERE p_size > 30 UNION ALL SELECT 'widgets', * FROM part WHERE p_name LIKE '%widget%') GROUP BY 1""")
def specification_summary(spark, folder):
    rows = H.by_specification(T.table(spark, folder, "part"), {"all": F.lit(True), "large": F.col("p_size") > 30, "widgets": F.col("p_name").contains("widget")})
    return rounded(rows.groupBy("specification").agg(F.count(F.lit(1)).alias("rows"), F.avg("p_retailprice").alias("mean")), "mean", digits=4)


_NESTED = """'{"a":{"b":' || props || ',"t":"' || event_type || '"}}'"""


@query(f"""SELECT event_id, json_extract_string({_NESTED}, '$.a.b.k') AS k, json_extract_string({_NESTED}, '$.a.t') AS t, json_extract_string({_NESTED}, '$.a.b.none') AS none, json_extract_string(props, '$.k') AS shallow FROM events""")
def nested_paths(spark, folder):
    events = T.table(spark, folder, "events")
    text = F.concat(F.lit('{"a":{"b":'), "props", F.lit(',"t":"'), "event_type", F.lit('"}}'))
    paths = {"k": ("a", "b", "k"), "t": ("a", "t"), "none": ("a", "b", "none")}
    return events.select("event_id", *(H.nested(text, *path).alias(name) for name, path in paths.items()), H.nested(F.col("props"), "k").alias("shallow"))


@query("SELECT p_partkey, round(p_retailprice * 1e6, 2) AS per_million, round(p_size * 1e-3, 6) AS seconds FROM part")
def unit_rescaling(spark, folder):
    return T.table(spark, folder, "part").select("p_partkey", F.round(H.rescaled(F.col("p_retailprice"), "usd_per_token"), 2).alias("per_million"), F.round(H.rescaled(F.col("p_size"), "ms"), 6).alias("seconds"))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS source_record FROM nation""")
def raw_records(spark, folder):
    return H.with_record(T.table(spark, folder, "nation")).select("n_nationkey", "source_record")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(NULL AS DOUBLE) AS score, CAST(p_size AS DOUBLE) AS size FROM part")
def observation_schema(spark, folder):
    parts = T.table(spark, folder, "part").withColumnsRenamed({"p_partkey": "id", "p_name": "name", "p_size": "size"})
    return H.onto_schema(parts, {"id": "string", "name": "string", "score": "double", "size": "double"})


@query("""SELECT l_orderkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) > 31 AS conflict,
 CASE WHEN abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) > 31 THEN 'source date ' || CAST(l_shipdate AS DATE) || ' is ' || date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) || ' days from ' || CAST(o_orderdate AS DATE) END AS explanation
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def date_conflicts(spark, folder):
    rows = T.table(spark, folder, "lineitem").join(T.table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    flag, why = H.date_conflict(F.to_date("o_orderdate"), F.to_date("l_shipdate"), 31)
    return rows.select("l_orderkey", "l_linenumber", flag.alias("conflict"), why.alias("explanation"))


@query("""SELECT * FROM (SELECT p_partkey, concat_ws('|', CASE WHEN p_size NOT BETWEEN 5 AND 45 THEN 'p_size' END, CASE WHEN p_retailprice NOT BETWEEN 1000 AND 1000 + 20 * p_size THEN 'p_retailprice' END) AS outside FROM part) WHERE outside <> ''""")
def range_guard(spark, folder):
    return H.range_violations(T.table(spark, folder, "part"), ["p_partkey"], {"p_size": (5, 45), "p_retailprice": (1000, 1000 + 20 * F.col("p_size"))})


@query("""SELECT l_orderkey, min(l_quantity) AS threshold, arg_min(l_extendedprice, struct_pack(q := l_quantity, e := l_extendedprice)) AS price FROM lineitem GROUP BY 1""")
def least_override(spark, folder):
    arrays = T.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("threshold"), F.col("l_extendedprice").alias("price"))).alias("o"))
    return arrays.withColumn("best", H.least_override(F.col("o"), "threshold", "price")).select("l_orderkey", "best.threshold", "best.price")


# ---------------------------------------------------------------- aggregates


@query("SELECT p_brand, max(p_retailprice) AS largest, arg_min(p_name, struct_pack(s := p_size, k := p_partkey)) AS first_label, count(*) AS rows FROM part GROUP BY 1")
def rollup_rows(spark, folder):
    return H.rollup_row(T.table(spark, folder, "part"), ["p_brand"], "p_retailprice", ["p_size", "p_partkey"], "p_name")


@query("""WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM events GROUP BY 1)
SELECT user_id, types, '{' || string_agg('"' || day || '":' || n, ',' ORDER BY day) || '}' AS by_day FROM d JOIN t USING (user_id) GROUP BY 1, 2""")
def joined_text(spark, folder):
    events = T.table(spark, folder, "events")
    days = events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    types = events.groupBy("user_id").agg(H.joined_values(F.col("event_type")).alias("types"))
    return types.join(days.groupBy("user_id").agg(H.json_series(F.col("day"), F.col("n")).alias("by_day")), "user_id")


@query("SELECT p_brand, p_type, median(p_retailprice) AS composite, count(*) AS members FROM part GROUP BY 1, 2 HAVING count(*) >= 3")
def composite_medians(spark, folder):
    return H.composite_medians(T.table(spark, folder, "part"), ["p_brand", "p_type"], "p_retailprice", 3)


@query("""SELECT p_brand, max(p_size) - min(p_size) AS "range", round(avg(p_size) FILTER (p_type = 'ECONOMY') - avg(p_size) FILTER (p_type <> 'ECONOMY'), 6) AS uplift FROM part GROUP BY 1""")
def range_and_uplift(spark, folder):
    return rounded(H.range_and_uplift(T.table(spark, folder, "part"), ["p_brand"], F.col("p_type") == "ECONOMY", "p_size"), "uplift")


@query("SELECT s_nationkey, sha256(string_agg(DISTINCT s_name, chr(10) ORDER BY s_name)) AS digest FROM supplier GROUP BY 1")
def line_digests(spark, folder):
    return T.table(spark, folder, "supplier").groupBy("s_nationkey").agg(H.line_digest(F.col("s_name")).alias("digest"))


@query("""WITH a AS (SELECT *, sum(s_acctbal) OVER (PARTITION BY s_nationkey) AS s, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_suppkey, round(CASE WHEN n > 1 THEN (s - s_acctbal) / (n - 1) END, 4) AS others_mean FROM a""")
def leave_one_out_means(spark, folder):
    return rounded(H.leave_one_out_means(T.table(spark, folder, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", "others_mean"), "others_mean", digits=4)


@query("SELECT p_brand, round(coalesce(avg(p_retailprice) FILTER (p_size > 48), avg(p_retailprice)), 4) AS p_retailprice, count(*) FILTER (p_size > 48) AS preferred_rows, count(*) AS rows FROM part GROUP BY 1")
def collapse_preferred(spark, folder):
    return rounded(H.collapse_preferred(T.table(spark, folder, "part"), ["p_brand"], F.col("p_size") > 48, "p_retailprice"), "p_retailprice", digits=4)


@query("""SELECT scope, count(*) AS n, round(avg(abs(e)), 6) AS mean_abs FROM (SELECT 'all' AS scope, ln(o_totalprice) - 11.5 AS e FROM orders UNION ALL SELECT 'frontier', ln(o_totalprice) - 11.5 FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'status ' || o_orderstatus, ln(o_totalprice) - 11.5 FROM orders) GROUP BY 1""")
def scope_summary(spark, folder):
    orders = T.table(spark, folder, "orders").withColumn("e", F.log("o_totalprice") - 11.5)
    scopes = {"all": F.lit(True), "frontier": F.col("o_totalprice") > 300000, **{f"status {s}": F.col("o_orderstatus") == s for s in ("F", "O", "P")}}
    return rounded(H.by_specification(orders, scopes, "scope").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mean_abs")), "mean_abs")


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def keep_last(spark, folder):
    orders = T.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return H.keep_last(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.5 ELSE 1.0 END / count(*) OVER (PARTITION BY s_nationkey) AS w FROM supplier) SELECT s_suppkey, round(w / (SELECT avg(w) FROM r), 6) AS weight FROM r""")
def equal_group_weights(spark, folder):
    return rounded(H.equal_group_weights(T.table(spark, folder, "supplier"), "s_nationkey", F.col("s_suppkey") % 4 == 0).select("s_suppkey", "weight"), "weight")


@query("SELECT p_brand, min(p_size) AS p_size, arg_min(p_partkey, struct_pack(s := p_size, k := p_partkey)) AS p_partkey FROM part GROUP BY 1")
def best_rows(spark, folder):
    return H.best_row(T.table(spark, folder, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand"], "p_size", ["p_partkey"])


@query("""WITH c AS (SELECT p_brand, p_partkey, p_size / 50.0 AS loss FROM part), n AS (SELECT *, min(loss) OVER (PARTITION BY p_brand) AS best FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC, loss) AS r FROM n WHERE loss <= best + 0.1) SELECT p_brand, p_partkey, loss FROM r WHERE r = 1""")
def near_ties(spark, folder):
    parts = T.table(spark, folder, "part").select("p_brand", "p_partkey", (F.col("p_size") / 50.0).alias("loss"))
    return near_best(parts, ["p_brand"], "loss", 0.1, F.desc("p_partkey"))


@query("""WITH c AS (SELECT p_brand, p_partkey, string_split(p_name, ' ') AS parts, p_retailprice / 1e6 AS loss FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(loss, 3), len(parts), array_to_string(parts, '|'), p_partkey) AS r FROM c) SELECT p_brand, array_to_string(parts, '|') AS parts, round(loss, 3) AS loss FROM r WHERE r = 1""")
def parsimony(spark, folder):
    parts = T.table(spark, folder, "part").select("p_brand", F.split("p_name", " ").alias("parts"), (F.col("p_retailprice") / 1e6).alias("loss"))
    return H.simplest_best(parts, ["p_brand"], "loss", "parts").select("p_brand", F.concat_ws("|", "parts").alias("parts"), F.round("loss", 3).alias("loss"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 450000 ORDER BY o_totalprice DESC, o_orderkey")
def threshold_listing(spark, folder):
    return H.listing(T.table(spark, folder, "orders"), F.col("o_totalprice") >= 450000, [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("SELECT DISTINCT p_brand FROM part WHERE trim(p_brand) <> ''")
def distinct_values(spark, folder):
    return H.distinct_values(T.table(spark, folder, "part"), "p_brand")


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS p_brand FROM part")
def disjoint_panels(spark, folder):
    parts = T.table(spark, folder, "part")
    return H.disjoint_union(parts.where("p_partkey % 2 = 0").select("p_partkey", "p_name", "p_size"), parts.where("p_partkey % 2 = 1").select("p_partkey", "p_name", "p_brand"), ["p_partkey"])


@query("""SELECT count(*) AS rows, CAST(count(*) FILTER (o_custkey IS NULL) AS BIGINT) AS null_keys, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys, false AS valid FROM orders""")
def load_contract(spark, folder):
    return H.unique_key_report(T.table(spark, folder, "orders"), ["o_custkey"])


@query("SELECT o_orderstatus, count(*) AS n_orders, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1")
def contract_enforced(spark, folder):
    orders = T.table(spark, folder, "orders")
    checked = H.require_contract(orders, orders.columns, ["o_orderkey"])
    return checked.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT p_partkey, p_name AS label, p_size FROM part")
def legacy_columns(spark, folder):
    renamed, applied = H.renamed_shim(T.table(spark, folder, "part").select("p_partkey", "p_name", "p_size"), {"p_name": "label", "absent": "other"})
    assert H.restored(renamed, applied).columns == ["p_partkey", "p_name", "p_size"]
    return renamed


# ---------------------------------------------------------------- panels


@query("SELECT p_partkey, coalesce(s_name, '') AS s_name, coalesce(s_acctbal, 0) AS s_acctbal FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def left_defaults(spark, folder):
    suppliers = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name", "s_acctbal")
    return P.left_with_defaults(T.table(spark, folder, "part").select("p_partkey"), suppliers, ["p_partkey"], {"s_name": "", "s_acctbal": 0.0})


@query("""WITH p AS (SELECT p_partkey, p_partkey - p_partkey % 10 AS parent, p_retailprice AS size, CAST(p_size AS INTEGER) AS day FROM part) SELECT c.p_partkey, c.parent FROM p c JOIN p ON p.p_partkey = c.parent WHERE abs(c.size / p.size - 1) <= 0.0003 AND c.day >= p.day""")
def parent_child(spark, folder):
    parts = T.table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") - F.col("p_partkey") % 10).alias("parent"), F.col("p_retailprice").alias("size"), F.col("p_size").alias("day"))
    return P.lineage(parts, "p_partkey", "parent", "size", "day", 0.0003).select("p_partkey", "parent")


@query("SELECT p_partkey, p_retailprice AS first, CAST(p_size AS DOUBLE) AS second FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0")
def shared_predictions(spark, folder):
    parts = T.table(spark, folder, "part")
    a, b = parts.where("p_partkey % 2 = 0").withColumn("v", F.col("p_retailprice")), parts.where("p_partkey % 3 = 0").withColumn("v", F.col("p_size").cast("double"))
    return P.shared_predictions(a, b, ["p_partkey"], "v")


@query("""WITH u AS (SELECT o_custkey AS k, 'a' AS p, count(*) AS s, min(CAST(o_orderdate AS DATE)) AS d, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, 'b', count(*), min(CAST(o_orderdate AS DATE)), max(o_totalprice) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT o_custkey, 'c', count(*), min(CAST(o_orderdate AS DATE)), max(o_totalprice) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT k AS o_custkey, count(DISTINCT p) AS components, round(max(v) FILTER (p = 'a'), 4) AS a, round(max(v) FILTER (p = 'b'), 4) AS b, round(max(v) FILTER (p = 'c'), 4) AS c FROM u GROUP BY 1 HAVING count(DISTINCT p) >= 2 AND max(s) / min(s) < 1.5 AND date_diff('day', min(d), max(d)) <= 620""")
def aligned_panels(spark, folder):
    orders = T.table(spark, folder, "orders")
    panel = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"), F.min(F.to_date("o_orderdate")).alias("day"), F.max("o_totalprice").alias("value"))
    out = P.aligned_panels({"a": panel("F"), "b": panel("O"), "c": panel("P")}, "o_custkey", "size", "day", "value", 2, 1.5, 620)
    return rounded(out, "a", "b", "c", digits=4)


@query("""WITH s AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT a.user_id AS first, b.user_id AS second, count(*) AS components, round(avg(b.v - a.v), 6) AS mean_difference FROM s a JOIN s b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type GROUP BY 1, 2""")
def common_components(spark, folder):
    scores = T.table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    pairs = scores.select(F.col("user_id").alias("first")).distinct().withColumn("second", F.col("first") + 1)
    return rounded(P.common_components(pairs, "first", "second", scores, "user_id", "event_type", "v"), "mean_difference")


@query("""WITH s AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders), n AS (SELECT m, lead(m) OVER (ORDER BY m) AS nx FROM s), t AS (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS trained, CAST(date_trunc('month', CAST(o_orderdate AS DATE) + 40) AS DATE) AS target, CAST(o_orderdate AS DATE) AS released FROM orders)
SELECT o_orderkey, coalesce(nx = target, false) AS adjacent, coalesce(nx = target, false) AND released > trained AND released <= target AS prospective FROM t LEFT JOIN n ON n.m = t.trained""")
def snapshot_adjacency(spark, folder):
    day = F.to_date("o_orderdate")
    rows = T.table(spark, folder, "orders").select("o_orderkey", F.trunc(day, "month").alias("trained"), F.trunc(F.date_add(day, 40), "month").alias("target"), day.alias("released"))
    months = T.table(spark, folder, "orders").select(F.trunc(day, "month").alias("stamp")).distinct()
    return P.immediate_successor(rows, months, "stamp", "trained", "target", "released").select("o_orderkey", "adjacent", "prospective")


@query("""WITH s AS (SELECT o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, o_totalprice AS v FROM orders), f AS (SELECT o_custkey, min(y) AS a, max(y) AS b, count(DISTINCT y) AS n FROM s GROUP BY 1)
SELECT o_custkey, a AS first_snapshot, min(v) FILTER (y = a) AS vintage, max(v) FILTER (y = b) AS latest, any_value(n) AS snapshots FROM s JOIN f USING (o_custkey) GROUP BY 1, 2""")
def score_vintage(spark, folder):
    scores = T.table(spark, folder, "orders").select("o_custkey", F.trunc("o_orderdate", "year").alias("year"), F.col("o_totalprice").alias("v"))
    return P.first_vintage(scores, "o_custkey", "year", "v")


@query("""SELECT p_partkey, c_custkey, concat_ws('|', CASE WHEN s_suppkey IS NULL THEN 'p_partkey' END, CASE WHEN n_nationkey IS NULL THEN 'c_custkey' END) AS missing FROM (SELECT p_partkey, p_partkey % 40 AS c_custkey FROM part) m LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN nation ON n_nationkey = c_custkey WHERE s_suppkey IS NULL OR n_nationkey IS NULL""")
def stale_map(spark, folder):
    mapping = T.table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("c_custkey"))
    left, right = T.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("p_partkey")), T.table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"))
    return P.stale_keys(mapping, left, right, "p_partkey", "c_custkey")


@query(f"""WITH {ORDERS}, h AS (SELECT nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, y AS v FROM orders_by_nation WHERE o_orderstatus = 'F'), t AS (SELECT o_orderkey, nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CASE WHEN o_orderkey % 3 = 0 THEN y END AS direct FROM orders_by_nation WHERE o_orderstatus <> 'F'),
a AS (SELECT m.m, h.nation, median(v) AS md, count(*) AS n FROM (SELECT DISTINCT m FROM t) m JOIN h ON h.m < m.m GROUP BY 1, 2), o AS (SELECT t.nation, t.m, median(md) AS md FROM (SELECT DISTINCT nation, m FROM t) t JOIN a ON a.m = t.m AND a.nation <> t.nation GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT o_orderkey, round(coalesce(direct, CASE WHEN a.n >= 8 THEN a.md END, o.md), 6) AS imputed, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN a.n >= 8 THEN 'own group' WHEN o.md IS NOT NULL THEN 'other groups' ELSE 'none' END AS tier
FROM t LEFT JOIN a ON a.m = t.m AND a.nation = t.nation LEFT JOIN o ON o.m = t.m AND o.nation = t.nation""")
def tiered_imputation(spark, folder):
    rows = orders_panel(spark, folder).select("o_orderkey", "o_orderstatus", "nation", F.trunc("o_orderdate", "month").alias("month"), F.col("y").alias("v"))
    asked = rows.where("o_orderstatus <> 'F'")
    out = P.tiered_imputation(asked.drop("v"), "o_orderkey", "nation", "month", asked.where("o_orderkey % 3 = 0"), rows.where("o_orderstatus = 'F'"), "v", 8, 3)
    return rounded(out.select("o_orderkey", "imputed", "tier"), "imputed")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def membership(spark, folder):
    buyers = T.table(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return P.members(T.table(spark, folder, "customer"), buyers, ["c_custkey"]).select("c_custkey")


@query("""WITH a AS (SELECT o_custkey, avg(o_totalprice) AS v, max(CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END) AS d FROM orders GROUP BY 1), b AS (SELECT o_custkey, median(o_totalprice) AS v, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1)
SELECT o_custkey, abs(a.v - b.v) <= 10000 AS agrees, coalesce(a.d, b.d) AS date_used, CASE WHEN a.d IS NOT NULL THEN 'published' ELSE 'fallback' END AS date_rule FROM a JOIN b USING (o_custkey)""")
def two_source_reconciliation(spark, folder):
    orders, day = T.table(spark, folder, "orders"), F.to_date("o_orderdate")
    a = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"), F.max(F.when(F.col("o_custkey") % 4 != 0, day)).alias("d"))
    b = orders.groupBy("o_custkey").agg(F.median("o_totalprice").alias("v"), F.min(day).alias("d"))
    return P.reconciled(a, b, "o_custkey", "v", "d", 10000.0)


@query("""WITH a AS (SELECT s_suppkey AS k, s_nationkey AS t FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN s_nationkey ELSE c_nationkey END AS t FROM customer JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_nationkey + 100 FROM supplier WHERE s_suppkey % 7 = 0),
r AS (SELECT s_suppkey AS k, (SELECT count(DISTINCT t) FROM a WHERE a.k = s_suppkey) AS na, (SELECT min(t) FROM a WHERE a.k = s_suppkey) AS ta, (SELECT count(DISTINCT t) FROM b WHERE b.k = s_suppkey) AS nb, (SELECT min(t) FROM b WHERE b.k = s_suppkey) AS tb FROM supplier),
l AS (SELECT *, CASE WHEN na > 1 OR nb > 1 THEN 'ambiguous' WHEN na = 1 AND nb = 1 AND ta = tb THEN 'agree' WHEN na = 1 AND nb = 1 THEN 'conflict' WHEN na = 1 THEN 'first only' WHEN nb = 1 THEN 'second only' ELSE 'none' END AS route FROM r)
SELECT k, route, CASE WHEN route IN ('agree', 'first only', 'second only') THEN coalesce(ta, tb) END AS target FROM l""")
def two_route_identity(spark, folder):
    suppliers, customers = T.table(spark, folder, "supplier"), T.table(spark, folder, "customer")
    first = suppliers.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("target"))
    joined = customers.join(suppliers, F.col("s_suppkey") == F.col("c_custkey"))
    second = joined.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("s_nationkey")).otherwise(F.col("c_nationkey")).alias("target"))
    second = second.unionByName(suppliers.where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") + 100).alias("target")))
    return P.two_routes(suppliers.select(F.col("s_suppkey").alias("k")), "k", first, second, "target").select("k", "route", "target")


@query("""SELECT l_orderkey, l_linenumber, greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS available FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) < DATE '1997-01-01'""")
def information_clock(spark, folder):
    rows = T.table(spark, folder, "lineitem").join(T.table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    dated = rows.select("l_orderkey", "l_linenumber", F.to_date("o_orderdate").alias("a"), F.to_date("l_shipdate").alias("b"))
    return P.known_before(dated, ["a", "b"], F.to_date(F.lit("1997-01-01"))).select("l_orderkey", "l_linenumber", "available")


@query(f"""WITH {ORDERS}, t AS (SELECT a.nation, avg(b.y) AS mean, regr_slope(b.y, b.x) AS slope, regr_intercept(b.y, b.x) AS intercept FROM (SELECT DISTINCT nation FROM orders_by_nation) a JOIN orders_by_nation b ON b.nation <> a.nation GROUP BY 1)
SELECT nation, predictor, round(avg(e), 6) AS mean_abs_error FROM (SELECT o.nation, 'line' AS predictor, abs(intercept + slope * x - y) AS e FROM orders_by_nation o JOIN t USING (nation) UNION ALL SELECT o.nation, 'mean', abs(mean - y) FROM orders_by_nation o JOIN t USING (nation)) GROUP BY 1, 2""")
def predictor_registry(spark, folder):
    def line(n, sx, sy, sxx, sxy):
        slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
        return (sy - slope * sx) / n, slope

    registry = {"mean": lambda n, sx, sy, sxx, sxy: (sy / n, F.lit(0.0)), "line": line}
    return rounded(P.held_predictors(orders_panel(spark, folder).select("nation", "x", "y"), "nation", "x", "y", registry), "mean_abs_error")


@query("""WITH d AS (SELECT sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS d FROM nation), w AS (SELECT i, sum(CAST(('0x' || substr(d, 8 * i + 1, 8)) AS UBIGINT)) AS s FROM d, range(8) t(i) GROUP BY 1)
SELECT (SELECT count(*) FROM nation) AS rows, sha256((SELECT CAST(count(*) AS VARCHAR) FROM nation) || '|' || string_agg(CAST(CAST(s AS HUGEINT) AS VARCHAR), '|' ORDER BY i)) AS digest FROM w""")
def content_freeze(spark, folder):
    return P.content_freeze(T.table(spark, folder, "nation").repartition(3), ["n_nationkey"])


@query("""WITH c AS (SELECT c_custkey, 'k' || c_custkey % 37 AS name, c_nationkey AS block FROM customer), s AS (SELECT s_suppkey, 'k' || s_suppkey % 41 AS name, s_nationkey AS block FROM supplier), n AS (SELECT name, count(*) AS n, min(s_suppkey) AS r FROM s GROUP BY 1), b AS (SELECT block, count(*) AS n, min(s_suppkey) AS r FROM s GROUP BY 1),
l AS (SELECT c_custkey, n.n AS n1, n.r AS r1, b.n AS n2, b.r AS r2 FROM c LEFT JOIN n USING (name) LEFT JOIN b USING (block))
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 3 WHEN n1 = 1 THEN r1 WHEN n1 > 1 OR c_custkey % 5 = 0 THEN NULL WHEN n2 = 1 THEN r2 END AS s_suppkey,
 CASE WHEN c_custkey % 11 = 0 THEN 'manual' WHEN n1 = 1 THEN 'exact name' WHEN n1 > 1 THEN 'ambiguous name' WHEN c_custkey % 5 = 0 THEN 'reviewed, none' WHEN n2 = 1 THEN 'only one in block' ELSE 'unmatched' END AS method,
 CAST(CASE WHEN c_custkey % 11 = 0 THEN 1.0 WHEN n1 = 1 THEN 0.95 WHEN n1 > 1 THEN 0.0 WHEN c_custkey % 5 = 0 THEN 1.0 WHEN n2 = 1 THEN 0.6 ELSE 0.0 END AS DOUBLE) AS confidence FROM l""")
def audited_match(spark, folder):
    customers, suppliers = T.table(spark, folder, "customer"), T.table(spark, folder, "supplier")
    left = customers.select("c_custkey", F.concat(F.lit("k"), F.col("c_custkey") % 37).alias("name"), F.col("c_nationkey").alias("block"))
    right = suppliers.select("s_suppkey", F.concat(F.lit("k"), F.col("s_suppkey") % 41).alias("name"), F.col("s_nationkey").alias("block"))
    manual = customers.where("c_custkey % 11 = 0").select("c_custkey", F.lit(3).cast("long").alias("s_suppkey"))
    return M.audited_match(left, right, "c_custkey", "s_suppkey", "name", "block", manual, customers.where("c_custkey % 5 = 0"))


@query("""WITH p AS (SELECT c_custkey, s_suppkey, greatest(c_acctbal / s_acctbal, s_acctbal / c_acctbal) AS g, 1 - levenshtein(c_name, s_name) / CAST(greatest(length(c_name), length(s_name)) AS DOUBLE) AS s FROM customer JOIN supplier ON c_acctbal > 0 AND s_acctbal > 0 AND greatest(c_acctbal / s_acctbal, s_acctbal / c_acctbal) <= 1.05),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY s DESC, round(g, 9), s_suppkey) AS r FROM p WHERE s >= 0.5) SELECT c_custkey, s_suppkey, round(s, 6) AS similarity FROM r WHERE r = 1""")
def size_ratio_match(spark, folder):
    customers = T.table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("size"), F.col("c_name").alias("name"))
    suppliers = T.table(spark, folder, "supplier").select("s_suppkey", F.col("s_acctbal").alias("size"), F.col("s_name").alias("name"))
    return rounded(M.ratio_match(customers, suppliers, "c_custkey", "s_suppkey", "size", "name", 1.05, 0.5), "similarity")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, abs(date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE))), o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE r = 1""")
def truth_resolution(spark, folder):
    distance = F.abs(F.datediff(F.to_date("o_orderdate"), F.lit("1997-06-01")))
    return M.with_priority(T.table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus", ["P", "F", "O"], [distance, F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT p_partkey, 'p_size' AS field, CAST(p_size AS VARCHAR) AS before, CASE WHEN p_partkey % 14 <> 0 THEN CAST(p_size + 1 AS VARCHAR) END AS after FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'p_brand', p_brand, 'none' FROM part WHERE p_partkey % 5 = 0""")
def field_changes(spark, folder):
    before = T.table(spark, folder, "part").select("p_partkey", "p_size", "p_brand", "p_name")
    size = F.when(F.col("p_partkey") % 14 == 0, None).when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    after = before.withColumn("p_size", size).withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.col("p_brand")))
    return M.field_changes(before, after, "p_partkey", ["p_size", "p_brand", "p_name"])


@query("""WITH u AS (SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier) SELECT kind, nation, count(*) AS rows, count(segment) AS segments, round(sum(balance), 2) AS balance FROM u GROUP BY 1, 2""")
def heterogeneous_union(spark, folder):
    customers = T.table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = T.table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    both = customers.unionByName(suppliers, allowMissingColumns=True)
    return both.groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("rows"), F.count("segment").alias("segments"), F.round(F.sum("balance"), 2).alias("balance"))


@query("""SELECT 'both' AS side, count(*) AS keys FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL SELECT 'orders only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 EXCEPT SELECT o_custkey FROM orders)""")
def key_sets(spark, folder):
    a = T.table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    b = T.table(spark, folder, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    counted = lambda df, side: df.agg(F.count(F.lit(1)).alias("keys")).select(F.lit(side).alias("side"), "keys")
    return counted(a.intersect(b), "both").unionByName(counted(a.subtract(b), "orders only")).unionByName(counted(b.subtract(a), "customers only"))


@query("SELECT p_brand, p_type, count(*) AS rows, count(DISTINCT p_name) AS entities, min(p_size) AS smallest, max(p_size) AS largest, round(avg(p_size), 6) AS mean FROM part GROUP BY 1, 2 HAVING count(*) >= 4 AND count(DISTINCT p_name) >= 3")
def supported_groups(spark, folder):
    return rounded(A.supported(T.table(spark, folder, "part"), ["p_brand", "p_type"], "p_name", "p_size", 4, 3), "mean")


@query("""SELECT s, p_brand, count(*) AS rows, round(avg(greatest(-s, least(s, (p_retailprice - 1400) / 300))), 6) AS mean FROM part, (SELECT CAST(unnest([0.5, 1.0, 2.0]) AS DOUBLE) AS s) GROUP BY 1, 2""")
def specification_grid(spark, folder):
    """Specifications that are data: each row is unfolded by the grid, whose size is fixed."""
    rows = T.table(spark, folder, "part").withColumn("s", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))))
    clipped = F.greatest(-F.col("s"), F.least(F.col("s"), (F.col("p_retailprice") - 1400) / 300))
    return rounded(rows.groupBy("s", "p_brand").agg(F.count(F.lit(1)).alias("rows"), F.avg(clipped).alias("mean")), "mean")


# ---------------------------------------------------------------- scalars


@query("""SELECT doc_id, length(k) AS letters, md5(k) AS key_digest FROM (SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g') AS k FROM documents)""")
def decomposed_keys(spark, folder):
    key = S.normal_key(F.col("text"))
    return T.table(spark, folder, "documents").select("doc_id", F.length(key).cast("long").alias("letters"), F.md5(key).alias("key_digest"))


@query("""SELECT doc_id, lang IN ('en', 'de') AS listed, coalesce(contains(lower(text), 'the ') OR contains(lower(text), 'http'), false) AS literal, coalesce(regexp_matches(text, '[0-9]{3}[- ][0-9]{2,}'), false) AS matching,
 coalesce(lang IN ('en', 'fr') AND contains(lower(text), 'é') AND regexp_matches(text, '[0-9]{2}'), false) AS together FROM documents""")
def predicate_modes(spark, folder):
    lang, text = F.col("lang"), F.col("text")
    together = S.accepted(lang, ("en", "fr")) & S.accepted(text, contains=("É",), pattern="[0-9]{2}")
    return T.table(spark, folder, "documents").select(
        "doc_id", S.accepted(lang, ("en", "de")).alias("listed"), S.accepted(text, contains=("The ", "HTTP")).alias("literal"),
        S.accepted(text, pattern="[0-9]{3}[- ][0-9]{2,}").alias("matching"), together.alias("together"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN './' WHEN 1 THEN '~/' WHEN 2 THEN '/home/jones/' ELSE '.\\' END || c_mktsegment AS path, '<name>' AS name_0, c_nationkey AS nation_0 FROM customer""")
def privacy_forms(spark, folder):
    kind = F.col("c_custkey") % 4
    folder_ = F.when(kind == 0, "/home/jo/work/").when(kind == 1, "/home/jo/").when(kind == 2, "/home/jones/").otherwise("\\home\\jo\\work\\")
    records = S.without_identities(F.array(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))), ("name",))
    path = S.portable_paths(F.concat(folder_, "c_mktsegment"), "/home/jo/work", "/home/jo")
    return T.table(spark, folder, "customer").select("c_custkey", path.alias("path"), records[0]["name"].alias("name_0"), records[0]["nation"].alias("nation_0"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS plain_key, 'https://hub.example/' || lower(replace(p_name, ' ', '-')) AS url FROM part""")
def key_and_url_modes(spark, folder):
    named = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " (Thinking)").otherwise(" high"))
    url = F.concat(F.lit(" HTTPS://hub.example/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 3 == 0, "/tree/main/").when(F.col("p_partkey") % 3 == 1, "/tree/master?x=1#y").otherwise("//"))
    return T.table(spark, folder, "part").select("p_partkey", S.normal_key(named, ("thinking", "high")).alias("plain_key"), S.normal_url(url).alias("url"))



@query("""SELECT p_partkey, p_type AS configuration, p_name AS base, CASE WHEN p_partkey % 2 = 0 THEN 'fast' END AS tier FROM part""")
def suffix_extraction(spark, folder):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "-think").when(F.col("p_partkey") % 3 == 1, "_Thinking").otherwise(""))
    tiered = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, " (fast)").otherwise(""))
    return T.table(spark, folder, "part").select("p_partkey", S.in_parentheses(F.concat(name, F.lit(" ("), "p_type", F.lit(") "))).alias("configuration"), S.without_suffix(name, "think", "thinking").alias("base"), S.in_parentheses(tiered).alias("tier"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS iso, CAST(o_orderdate AS DATE) AS named, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders""")
def date_parsing(spark, folder):
    day = F.col("o_orderdate")
    iso = F.when(F.col("o_orderkey") % 3 != 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    named = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "d MMM yyyy"))
    return T.table(spark, folder, "orders").select("o_orderkey", S.iso_date(iso).alias("iso"), S.named_month_date(named).alias("named"), F.datediff(F.to_date(day), F.lit("1995-01-01")).cast("long").alias("days"))


@query("SELECT p_partkey, round(log2(p_retailprice), 6) AS binary_log, round(ln(1 + p_size), 6) AS log_plus_one, round(log10(p_retailprice), 6) AS decimal_log, round(exp(p_size / 50.0), 6) AS exponential FROM part")
def logarithms(spark, folder):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return T.table(spark, folder, "part").select("p_partkey", F.round(F.log2(price), 6).alias("binary_log"), F.round(F.log1p(size), 6).alias("log_plus_one"), F.round(F.log10(price), 6).alias("decimal_log"), F.round(F.exp(size / 50.0), 6).alias("exponential"))


@query("SELECT p_partkey, round(120 + ln(greatest(0.001, least(0.999, p_size / 60.0)) / (1 - greatest(0.001, least(0.999, p_size / 60.0)))) / 0.3, 6) AS implied FROM part")
def implied_index(spark, folder):
    return T.table(spark, folder, "part").select("p_partkey", F.round(S.implied_index(F.lit(120.0), F.lit(0.3), F.col("p_size") / 60.0), 6).alias("implied"))


@query("""SELECT p_partkey, printf('%.3f', p_retailprice) AS fixed, printf('%.1f', 100 * (p_size / 70.0)) || '%' AS percent, '{"a_size":' || p_size || ',"b_name":"' || p_name || '","c_none":null}' AS canonical FROM part""")
def text_formats(spark, folder):
    canonical = S.canonical_json({"b_name": F.col("p_name"), "c_none": F.lit(None).cast("string"), "a_size": F.col("p_size")})
    return T.table(spark, folder, "part").select("p_partkey", S.fixed(F.col("p_retailprice"), 3).alias("fixed"), S.percent(F.col("p_size") / 70.0).alias("percent"), canonical.alias("canonical"))


@query("""SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS words, string_split(p_name, ' ')[1] AS first_word, string_split(p_name, ' ')[-1] AS last_word, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))), '|') AS sorted_words FROM part""")
def array_handling(spark, folder):
    words = F.split("p_name", " ")
    both = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    return T.table(spark, folder, "part").select("p_partkey", F.size(words).alias("words"), F.element_at(words, 1).alias("first_word"), F.element_at(words, -1).alias("last_word"), F.concat_ws("|", F.array_sort(F.array_distinct(both))).alias("sorted_words"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size > 1 THEN 'mixture' ELSE 'dense' END AS architecture, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS experts FROM part""")
def architecture_class(spark, folder):
    leaves = F.array(F.lit("hidden_size"), F.when(F.col("p_partkey") % 3 == 0, "num_experts_per_layer").otherwise("num_layers"))
    kind, most = S.architecture(leaves, F.array(F.lit(4096), F.col("p_size")))
    return T.table(spark, folder, "part").select("p_partkey", kind.alias("architecture"), most.alias("experts"))


# ---------------------------------------------------------------- documents


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, '/a/b/0' AS pointer, k AS value_text, CAST(k AS DOUBLE) AS value FROM e UNION ALL SELECT event_id, '/a/b/1/c', CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END, event_id % 2 = 0 FROM e UNION ALL SELECT event_id, '/t~1x', 'word', NULL FROM e""")
def deep_leaves(spark, folder):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"a": {"b": ['), k, F.lit(', {"c": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit(', "n": null}]}, "t/x": "word"}'))
    return D.deep_leaves(T.table(spark, folder, "events").withColumn("j", text), ["event_id"], "j")


@query("""SELECT p_partkey, p_brand AS endpoint, tier, CAST(p_size AS DOUBLE) * CASE tier WHEN 'fast' THEN 2 ELSE 1 END AS price FROM part, (VALUES ('fast'), ('standard')) t(tier)""")
def payload_tiers(spark, folder):
    price = lambda m: F.struct((F.col("p_size").cast("double") * m).alias("price"))
    parts = T.table(spark, folder, "part").withColumn("tiers", F.create_map(F.concat("p_brand", F.lit("::fast")), price(2), F.col("p_brand"), price(1)))
    return D.tier_rows(parts, ["p_partkey"], "tiers", "standard")


@query("""WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), b AS (SELECT c_custkey, c_nationkey, c_acctbal + CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer)
SELECT count(*) AS rows, count(DISTINCT c_name) AS pseudonyms, count(*) FILTER (length(sha256('salt' || c_name)) = 64) AS hidden, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM a)) AS changed_numbers, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS changed_when_spoiled FROM customer""")
def privacy_projection(spark, folder):
    """Names become pseudonyms; the numbers beside them must be the same multiset as before, and a table with spoiled numbers is caught."""
    customers = T.table(spark, folder, "customer")
    hidden = T.pseudonyms(customers, ["c_name"], "salt")
    spoiled = hidden.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 50 == 0, 1).otherwise(0))
    numbers = ["c_custkey", "c_nationkey", "c_acctbal"]
    changed = lambda df, name: M.multiset_difference(customers, df, numbers).agg(F.count(F.lit(1)).alias(name))
    counts = hidden.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c_name").alias("pseudonyms"), F.count_if(F.length("c_name") == 64).alias("hidden"))
    return counts.crossJoin(changed(hidden, "changed_numbers")).crossJoin(changed(spoiled, "changed_when_spoiled"))  # single rows
