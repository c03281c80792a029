"""Deterministic resampling: draws come from digests, so any engine and any partitioning gives the same ones."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import beside
from tidemark.session import materialize, shuffle_partitions


def digest_number(*parts: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 of the parts joined by '|', as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, within: list[str], order: str, number: str = "_k", total: str = "_m") -> DataFrame:
    """Rows of each key in `within` (of all, without any) numbered from 0 by `order`, with how many there are; nulls come first.

    Rows are dealt to ranges of (key, order), which are written once, so that their bounds stay; numbers run inside a range
    and start at the sum of a key's earlier ranges. No task sorts or holds a whole key. Ties of `order` share a range and come in any order.
    """
    ranged = materialize(df.repartitionByRange(*within, order).withColumn("_slice", F.spark_partition_id()))
    sizes = ranged.groupBy(*within, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a key's ranges, not its rows
    starts = sizes.select(*within, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(*within)).alias(total))
    inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy(*within, "_slice").orderBy(order)) - 1)
    return beside(inside, starts, [*within, "_slice"]).withColumn(number, F.col("_start") + F.col("_inside")).drop("_slice", "_start", "_inside")


def drawn(cells: DataFrame, draws: int, seed: int) -> DataFrame:
    """Of each draw as many slots as there are numbered cells, each with the number of the cell that it takes."""
    slots = cells.select(F.col("_k").alias("slot"), "_m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return slots.select("draw", "slot", (digest_number(F.lit(seed), F.col("draw"), F.col("slot")) % F.col("_m")).alias("_k"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, draws: int, seed: int, by_row: bool = False) -> DataFrame:
    """The mean of cluster means (or of the clusters' pooled rows) with its 5 % to 95 % interval and the share of draws under zero.

    Rows are summed by cluster first. Draws times clusters then meet the clusters by number: the grid depends on the
    number of clusters, not of rows.
    """
    cells = df.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    placed = numbered(cells, [], cluster)
    weight = F.sum("_s") / F.sum("_n") if by_row else F.avg(F.col("_s") / F.col("_n"))
    each = drawn(placed, draws, seed).join(placed.select("_k", "_s", "_n"), "_k").groupBy("draw").agg(weight.alias("_v"))
    observed = cells.agg(weight.alias("observed"), F.count(F.lit(1)).alias("clusters"))
    spread = each.agg(F.percentile("_v", F.lit(0.05)).alias("low"), F.percentile("_v", F.lit(0.95)).alias("high"), F.avg((F.col("_v") < 0).cast("double")).alias("share_below_zero"))
    return observed.crossJoin(spread)


def max_t_sign_flips(df: DataFrame, test: str, cluster: str, value: str, flips: int, seed: int) -> DataFrame:
    """Family-wise p-values: of each test the share of sign flips whose largest studentised mean reaches its own.

    Works on cluster means; a flip gives each cluster one sign that all tests share.
    """
    cells = df.groupBy(test, cluster).agg(F.avg(value).alias("_v"))
    studentised = lambda v: F.abs(F.avg(v)) / F.greatest(F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(1e-12))
    own = cells.groupBy(test).agg(F.count(F.lit(1)).alias("clusters"), studentised(F.col("_v")).alias("statistic"))
    signs = df.select(cluster).distinct().crossJoin(df.sparkSession.range(flips).withColumnRenamed("id", "flip"))
    signed = signs.withColumn("_g", F.when(digest_number(F.lit(seed), F.col("flip"), F.col(cluster)) % 2 == 0, 1.0).otherwise(-1.0))
    tops = cells.join(signed, cluster).groupBy("flip", test).agg(studentised(F.col("_v") * F.col("_g")).alias("_t")).groupBy("flip").agg(F.max("_t").alias("_top"))
    reached = own.crossJoin(tops).groupBy(test).agg(F.count_if(F.col("_top") >= F.col("statistic") - 1e-9).alias("_hits"))
    return own.join(reached, test).select(test, "clusters", "statistic", ((F.col("_hits") + 1) / F.lit(flips + 1.0)).alias("p_value"))


#: Below these 32-bit numbers a draw counts a cluster 0, 1, 2, ... times: cumulative chances of the Poisson distribution of mean 1.
POISSON = tuple(int(p * (1 << 32)) for p in accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def digest_text(*parts: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 of the parts joined by '|'; as texts they are in the order of their numbers."""
    return F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8)


def poisson_number(digits: Column) -> Column:
    """A Poisson number of mean 1 from the digits of :func:`digest_text`."""
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(digits < f"{POISSON[k]:08x}", k).otherwise(out)
    return out


def poisson_weight(*parts: Column) -> Column:
    """How often a draw counts a cluster: a Poisson number of mean 1 from the digest of the parts."""
    return poisson_number(digest_text(*parts))


def poisson_sums(cells: DataFrame, levels: list[list[str]], by: list[str], sums: dict[str, Column], draws: int, seed: int) -> DataFrame:
    """(draw, by, sums): what each draw of clusters adds up to, where a cluster's rows count as often as its digest says.

    `cells` has a row for each cluster (of the finest level). Each level, a list of columns, draws a number of its own, and they are multiplied:
    with two, whole outer clusters are drawn and inner ones in them. Clusters aren't numbered and never meet each other; tasks add
    up their own, so what is shuffled is a row for each draw and task. For clusters in their thousands the numbers drawn differ little from
    drawing as many clusters as there are.

    Draws times clusters digests are the work. Clusters are dealt over all tasks first, since few bytes of them are much work. Digests
    are columns of their own, so that each is taken once; an inner one is taken only where the outer number isn't zero, and no filter
    follows, since Spark would push it below and take all digests again.
    """
    dealt = cells.repartition(shuffle_partitions(cells.sparkSession), F.xxhash64(*levels[-1]))  # of another kind than that of the cells, which may be few partitions
    drawn = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("_w", F.lit(1))
    for at, level in enumerate(levels):
        digits = digest_text(F.lit(seed + at), F.col("draw"), *map(F.col, level))
        drawn = drawn.withColumn("_u", F.when(F.col("_w") > 0, digits) if at else digits)
        drawn = drawn.withColumn("_w", F.when(F.col("_w") > 0, F.col("_w") * poisson_number(F.col("_u"))).otherwise(0) if at else poisson_number(F.col("_u")))
    counted = drawn.groupBy("draw", *by).agg(*(F.sum(F.col("_w") * c).alias(name) for name, c in sums.items()), F.max("_w").alias("_w"))
    return counted.where("_w > 0").drop("_w")


def spread(each: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """The 5 %, 50 % and 95 % points of a statistic over draws, the share under zero, and the draws in which it is defined."""
    v = value
    return each.groupBy(*(by or [])).agg(
        F.percentile(v, F.lit(0.05)).alias("low"), F.percentile(v, F.lit(0.5)).alias("middle"), F.percentile(v, F.lit(0.95)).alias("high"), F.avg((v < 0).cast("double")).alias("share_below_zero"), F.count(v).alias("defined")
    )


def poisson_bootstrap(df: DataFrame, cluster: list[str], value: str, draws: int, seed: int, by_row: bool = False, outer: list[str] | None = None) -> DataFrame:
    """The mean of cluster means (or of the clusters' pooled rows), observed and over draws; with `outer`, clusters are drawn inside outer ones."""
    keys = [*(outer or []), *cluster]
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).cast("double").alias("_n"))
    sums = {"a": F.col("_s"), "b": F.col("_n")} if by_row else {"a": F.col("_s") / F.col("_n"), "b": F.lit(1.0)}
    observed = cells.agg((F.sum(sums["a"]) / F.sum(sums["b"])).alias("observed"), F.count(F.lit(1)).alias("clusters"))
    each = poisson_sums(cells, [outer, keys] if outer else [keys], [], sums, draws, seed)
    return observed.crossJoin(spread(each, F.col("a") / F.col("b")))  # single rows
