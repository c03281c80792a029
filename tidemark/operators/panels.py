"""Joins of panels: alignment, lineage, imputation, reconciliation and what was known when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefixes import prefix_medians
from tidemark.session import materialize

def left_with_defaults(df: DataFrame, other: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """All rows of the left side; where the right one lacks a row or a value, its default."""
    return df.join(other, keys, "left").fillna(defaults)


def lineage(df: DataFrame, key: str, parent: str, size: str, day: str, tolerance: float) -> DataFrame:
    """Children with their parents where sizes agree within a share and the child isn't the older one."""
    parents = df.select(F.col(key).alias("_pk"), F.col(size).alias("_ps"), F.col(day).alias("_pd"))
    joined = df.join(parents, F.col(parent) == F.col("_pk"))
    fit = (F.col("_ps") > 0) & (F.abs(F.col(size) / F.col("_ps") - 1) <= tolerance) & (F.col(day) >= F.col("_pd"))
    return joined.where(fit).drop("_pk", "_ps", "_pd")


def shared_predictions(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that both prediction sets hold, with both values."""
    return a.select(*keys, F.col(value).alias("first")).join(b.select(*keys, F.col(value).alias("second")), keys)


def aligned_panels(panels: dict[str, DataFrame], key: str, size: str, day: str, value: str, least: int, size_ratio: float, days: int) -> DataFrame:
    """Entities that enough panels hold with sizes and dates that agree: a union and one aggregate, in place of chained outer joins."""
    each = [p.select(key, F.lit(n).alias("_panel"), F.col(size).cast("double").alias("_size"), F.col(day).alias("_day"), F.col(value).cast("double").alias("_value")) for n, p in panels.items()]
    union = each[0]
    for p in each[1:]:
        union = union.unionByName(p)
    found = union.groupBy(key).agg(
        F.count_distinct("_panel").alias("components"),
        *(F.max(F.when(F.col("_panel") == n, F.col("_value"))).alias(n) for n in panels),
        (F.max("_size") / F.min("_size")).alias("_ratio"),
        F.datediff(F.max("_day"), F.min("_day")).alias("_days"),
    )
    return found.where(f"components >= {least} and _ratio < {size_ratio} and _days <= {days}").drop("_ratio", "_days")


def common_components(pairs: DataFrame, first: str, second: str, scores: DataFrame, entity: str, component: str, value: str) -> DataFrame:
    """For pairs of entities, the components that both have, and the mean difference of their values."""
    a = scores.select(F.col(entity).alias(first), component, F.col(value).alias("_a"))
    b = scores.select(F.col(entity).alias(second), component, F.col(value).alias("_b"))
    joined = pairs.join(a, first).join(b, [second, component])
    return joined.groupBy(first, second).agg(F.count(F.lit(1)).alias("components"), F.avg(F.col("_b") - F.col("_a")).alias("mean_difference"))


def immediate_successor(df: DataFrame, snapshots: DataFrame, stamp: str, trained: str, target: str, released: str) -> DataFrame:
    """Whether a target snapshot follows right after the training one, and the release lies between them. Snapshots are distinct stamps."""
    following = snapshots.select(stamp).distinct().withColumn("_next", F.lead(stamp).over(Window.orderBy(stamp))).withColumnRenamed(stamp, trained)
    joined = df.join(following, trained, "left")
    adjacent = F.coalesce(F.col("_next") == F.col(target), F.lit(False))
    between = (F.col(released) > F.col(trained)) & (F.col(released) <= F.col(target))
    return joined.withColumn("adjacent", adjacent).withColumn("prospective", adjacent & F.coalesce(between, F.lit(False))).drop("_next")


def first_vintage(scores: DataFrame, entity: str, snapshot: str, value: str) -> DataFrame:
    """Each entity's value in the first snapshot that holds it (the smallest of several), and in the last."""
    row = F.struct(snapshot, value)
    out = scores.where(f"{value} is not null").groupBy(entity).agg(F.min(row).alias("_f"), F.max(row).alias("_l"), F.count_distinct(snapshot).alias("snapshots"))
    return out.select(entity, F.col(f"_f.{snapshot}").alias("first_snapshot"), F.col(f"_f.{value}").alias("vintage"), F.col(f"_l.{value}").alias("latest"), "snapshots")


def stale_keys(mapping: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of a manual map whose keys one of the two sides lacks, and which; empty for a map that holds."""
    a = left.select(F.col(left_key).alias(left_key), F.lit(True).alias("_l")).distinct()
    b = right.select(F.col(right_key).alias(right_key), F.lit(True).alias("_r")).distinct()
    joined = mapping.join(a, left_key, "left").join(b, right_key, "left")
    missing = F.concat_ws("|", F.when(F.col("_l").isNull(), left_key), F.when(F.col("_r").isNull(), right_key))
    return joined.withColumn("missing", missing).where("missing <> ''").drop("_l", "_r")


def medians_of_others(medians: DataFrame, asked: DataFrame, group: str, day: str) -> DataFrame:
    """For each (group, day) of `asked` the median of the day's other groups' medians, and how many these are.

    `medians` has (group, day, median). Groups are ranked once a day; leaving one out moves the two middle ranks by at most one,
    so four values a day answer for all groups.
    """
    order = Window.partitionBy(day).orderBy("median", group)
    ranked = medians.withColumn("_p", F.row_number().over(order)).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(day)))
    lower, upper = F.floor(F.col("_k") / 2), F.floor((F.col("_k") + 1) / 2)  # middle ranks of one group fewer
    at = lambda rank: F.max(F.when(F.col("_p") == rank, F.col("median")))
    middle = ranked.groupBy(day, "_k").agg(at(lower).alias("_a"), at(lower + 1).alias("_b"), at(upper).alias("_c"), at(upper + 1).alias("_d"))
    met = asked.select(group, day).distinct().join(middle, day).join(ranked.select(group, day, "_p"), [group, day], "left")
    low = F.when(lower >= F.col("_p"), F.col("_b")).otherwise(F.col("_a"))
    high = F.when(upper >= F.col("_p"), F.col("_d")).otherwise(F.col("_c"))
    whole = (F.when(F.col("_k") % 2 == 1, F.col("_c")).otherwise(F.col("_a")) + F.when(F.col("_k") % 2 == 1, F.col("_c")).otherwise(F.col("_b"))) / 2
    out = F.when(F.col("_p").isNull(), whole).otherwise((low + high) / 2)
    return met.select(group, day, out.alias("others"), (F.col("_k") - F.col("_p").isNotNull().cast("int")).alias("groups"))


def tiered_imputation(df: DataFrame, key: str, group: str, day: str, direct: DataFrame, history: DataFrame, value: str, least_own: int, least_groups: int) -> DataFrame:
    """A value measured on the same key; else the median of enough earlier ones of its group; else the median over enough other groups of their medians.

    `history` has (group, day, value). Medians of what a group had before a day come from sets that grow (:mod:`prefixes`), so no
    history row meets a later day; a day's other groups are answered for from the ranks of their medians.
    """
    asked = df.select(group, day).distinct()
    days = df.agg(F.collect_set(day).alias("_days"))  # one row
    every = history.select(group).distinct().crossJoin(days).select(group, F.explode("_days").alias(day))
    medians = materialize(prefix_medians(history, every, [group], day, value))
    own = medians.where(f"n >= {least_own}").select(group, day, F.col("median").alias("_own"))
    others = medians_of_others(medians, asked, group, day).where(f"groups >= {least_groups}").select(group, day, F.col("others").alias("_other"))
    joined = df.join(direct.select(key, F.col(value).alias("_direct")), key, "left").join(own, [group, day], "left").join(others, [group, day], "left")
    tier = F.when(F.col("_direct").isNotNull(), "direct").when(F.col("_own").isNotNull(), "own group").when(F.col("_other").isNotNull(), "other groups").otherwise("none")
    return joined.withColumn("imputed", F.coalesce("_direct", "_own", "_other")).withColumn("tier", tier).drop("_direct", "_own", "_other")


def members(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in a set, each once."""
    return df.join(held.select(*keys), keys, "left_semi")


def reconciled(a: DataFrame, b: DataFrame, key: str, value: str, day: str, tolerance: float) -> DataFrame:
    """One entity from two publishers: whether the values agree, and the date to use with the rule that chose it."""
    joined = a.select(key, F.col(value).alias("_a"), F.col(day).alias("_da")).join(b.select(key, F.col(value).alias("_b"), F.col(day).alias("_db")), key)
    rule = F.when(F.col("_da").isNotNull(), "published").when(F.col("_db").isNotNull(), "fallback").otherwise("none")
    return joined.select(key, (F.abs(F.col("_a") - F.col("_b")) <= tolerance).alias("agrees"), F.coalesce("_da", "_db").alias("date_used"), rule.alias("date_rule"))


def two_routes(df: DataFrame, key: str, first: DataFrame, second: DataFrame, target: str) -> DataFrame:
    """An identity by two routes, each a table (key, target) that may hold several targets: agree, one only, ambiguous, conflict or none."""
    route = lambda t, n: t.groupBy(key).agg(F.count_distinct(target).alias(f"_{n}"), F.min(target).alias(f"_{n}t"))
    joined = df.join(route(first, "a"), key, "left").join(route(second, "b"), key, "left")
    a, b = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    label = (
        F.when((a > 1) | (b > 1), "ambiguous").when((a == 1) & (b == 1), F.when(F.col("_at") == F.col("_bt"), "agree").otherwise("conflict")).when(a == 1, "first only").when(b == 1, "second only").otherwise("none")
    )
    named = joined.withColumn("route", label)
    return named.withColumn(target, F.when(F.col("route").isin("agree", "first only", "second only"), F.coalesce("_at", "_bt"))).drop("_a", "_b", "_at", "_bt")


def available(*dates: Column) -> Column:
    """The day from which something may be used: the latest of its dates; null while any is unknown."""
    known = dates[0].isNotNull()
    for d in dates[1:]:
        known = known & d.isNotNull()
    return F.when(known, F.greatest(*dates) if len(dates) > 1 else dates[0])


def known_before(df: DataFrame, dates: list[str], cutoff: Column) -> DataFrame:
    """Rows whose last date is strictly before the cutoff."""
    return df.withColumn("available", available(*map(F.col, dates))).where(F.col("available") < cutoff)


def held_predictors(cells: DataFrame, group: str, x: str, y: str, predictors: dict) -> DataFrame:
    """Each registered predictor's error on every group when that group is left out.

    A predictor makes two Columns (constant, slope) from the sums n, sx, sy, sxx, sxy of the training groups.
    """
    sums = {"n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y))}
    own = cells.groupBy(group).agg(*(v.alias(k) for k, v in sums.items()))
    total = own.agg(*(F.sum(k).alias(f"_{k}") for k in sums))
    train = own.crossJoin(total).select(group, *((F.col(f"_{k}") - F.col(k)).alias(k) for k in sums))  # the total is one row
    named = train.select(group, F.explode(F.array(*(F.struct(F.lit(n).alias("predictor"), *(c.alias(a) for c, a in zip(p(*map(F.col, sums)), ("_a", "_b")))) for n, p in predictors.items()))).alias("_p")).select(group, "_p.*")
    error = F.abs(F.col("_a") + F.col("_b") * F.col(x) - F.col(y))
    return cells.join(named, group).groupBy(group, "predictor").agg(F.avg(error).alias("mean_abs_error"))


def content_freeze(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row that any change of content changes, whatever the order and the partitions: rows and eight sums of the rows' digests, hashed.

    Equal rows count as often as they occur.
    """
    digest = df.select(F.sha2(F.to_json(F.struct(*keys, *sorted(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"}), 256).alias("_d"))
    words = [F.sum(F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for i in range(8)]
    return digest.agg(F.count(F.lit(1)).alias("rows"), *(w.alias(f"_{i}") for i, w in enumerate(words))).select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *(f"_{i}" for i in range(8))), 256).alias("digest"))
