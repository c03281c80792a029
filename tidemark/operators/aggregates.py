"""Grouped robust and weighted statistics. All are partial aggregates or windows inside a group; none collects rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import discard, materialize

MAD_SCALE = 1.4826
#: Of the sketches that bracket a quantile: ranks are right to one in so many.
ACCURACY = 10_000


def cumulative_counts(df: DataFrame, keys: list[str], value: str, slices: int = 32, weight: Column | None = None) -> DataFrame:
    """Each distinct value of a key with its rows (or the sum of a weight) and those below it.

    Values are counted first, and a key's values are cut into slices at approximate quantiles; running sums go inside a slice and
    over a key's few slices, so that no task sorts or holds a whole key.
    """
    counts = df.groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("rows"))
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], F.lit(1000)).alias("_e"))
    cut = beside(counts, edges, keys).withColumn("_s", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_s").agg(F.sum("rows").alias("_t")).withColumn("_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    inside = F.coalesce(F.sum("rows").over(Window.partitionBy(*keys, "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return beside(cut, starts, [*keys, "_s"]).withColumn("before", F.col("_b") + inside).drop("_s", "_b")


def beside(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with what a table has for its keys (null ones too); without keys the table is one row."""
    if not keys:
        return df.crossJoin(table)
    named = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]).drop(*(f"_key_{k}" for k in keys))


def quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float], few: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, for keys of any size: the two order statistics around each level.

    With `few` keys their brackets are broadcast; else Spark chooses by sizes it estimates, and unfolded rows look small to it.

    Sketches bracket each level between two values that are sure to lie on either side of it. A second pass counts the rows between brackets, and the
    values inside them one by one, so a few in ten thousand values of a large key are shuffled and sorted; a small key's are all.
    """
    held = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_q"))
    margin, small = 3 / ACCURACY, 2 * ACCURACY
    shares = [p for q in levels.values() for p in (max(0.0, q - margin), min(1.0, q + margin))]
    edges = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_q").alias("_least"), F.max("_q").alias("_most"), F.percentile_approx("_q", shares, F.lit(ACCURACY)).alias("_edges"))
    joined, v, tiny = beside(held, F.broadcast(edges) if few else edges, keys), F.col("_q"), F.col("_n") < small
    pairs = [(F.when(tiny, F.col("_least")).otherwise(F.col("_edges")[2 * i]), F.when(tiny, F.col("_most")).otherwise(F.col("_edges")[2 * i + 1])) for i in range(len(levels))]
    region = reduce(lambda a, b: a + b, ((v >= low).cast("int") + (v > high).cast("int") for low, high in pairs))
    inside = reduce(lambda a, b: a | b, (v.between(low, high) for low, high in pairs))
    counted = joined.groupBy(*keys, "_n", region.alias("_region"), F.when(inside, v).alias("_q")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_region", "_q").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    place = {n: (F.col("_n") - 1) * F.lit(q) for n, q in levels.items()}
    at = lambda rank: F.max(F.when((F.col("_before") <= rank) & (F.col("_before") + F.col("_rows") > rank), v))
    found = placed.groupBy(*keys, "_n").agg(*(at(f(p)).alias(f"_{n}{k}") for n, p in place.items() for k, f in (("l", F.floor), ("h", F.ceil))))
    return found.select(*keys, *((F.col(f"_{n}l") + (F.col(f"_{n}h") - F.col(f"_{n}l")) * (p - F.floor(p))).alias(n) for n, p in place.items()))


def size_medians(df: DataFrame, keys: list[str], value: str, name: str, cells: int = 2048) -> DataFrame:
    """Exact medians of values that aren't negative, for keys of any size, from two passes without sketches; none of the rows' columns is null.

    The first counts rows by `cells` buckets to each factor of e; the second takes, value by value, the one or two buckets that hold the
    middle. What lies between is written, so that Spark knows how small it is and doesn't shuffle the rows to meet it.
    """
    bucketed = df.select(*keys, F.col(value).alias("_q"), F.coalesce(F.floor(F.log(F.when(F.col(value) > 0, F.col(value))) * cells), F.lit(-(1 << 62))).alias("_b"))
    counts = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("*", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(*keys)).alias("_n"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    holds = lambda rank: (F.col("_before") <= rank) & (F.col("_before") + F.col("_rows") > rank)
    middle = materialize(placed.where(holds(low) | holds(high)).select(*keys, "_b", "_before", "_n"))
    inside = beside(bucketed, middle, [*keys, "_b"]).groupBy(*keys, "_b", "_before", "_n", "_q").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy(*keys, "_b").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
    ends = ranked.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("_q"))).alias("_l"), F.max(F.when(holds(high), F.col("_q"))).alias("_h"))
    out = materialize(ends.select(*keys, F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise(F.col("_l") + (F.col("_h") - F.col("_l")) * 0.5).alias(name)))
    discard(middle)
    return out


def geometric_mean(x: Column) -> Column:
    """Of the positive values; others don't count."""
    return F.exp(F.avg(F.when(x > 0, F.log(x))))


def weighted_geometric_mean(x: Column, w: Column) -> Column:
    held = (x > 0) & w.isNotNull()
    return F.exp(F.sum(F.when(held, w * F.log(x))) / F.sum(F.when(held, w)))


def error_bundle(df: DataFrame, keys: list[str], error: str) -> DataFrame:
    """What a set of log10 errors says: counts, typical and tail factors, bias and shares within factors."""
    e, size = F.col(error), F.abs(F.col(error))
    within = lambda factor: F.avg((size <= F.log10(F.lit(factor))).cast("double"))
    held = df.where(e.isNotNull())
    factors = {"median_factor": 0.5, "p80_factor": 0.8, "p90_factor": 0.9}
    sized = quantiles(held.select(*keys, size.alias("_size")), keys, "_size", factors)
    sums = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.pow(F.lit(10.0), F.avg(size)).alias("geomean_factor"),
        F.sqrt(F.avg(e * e)).alias("rmse_log10"),
        F.pow(F.lit(10.0), F.avg(e)).alias("bias_factor"),
        within(1.5).alias("within_1_5"),
        within(2.0).alias("within_2"),
        within(3.0).alias("within_3"),
    )
    return beside(sums, sized.withColumns({f: F.pow(F.lit(10.0), F.col(f)) for f in factors}), keys)


def _cumulative_weights(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Distinct values with their weight (rows), the weight below them (before) and the key's whole weight (_t)."""
    sums = cumulative_counts(df.where(f"{weight} > 0 and {value} is not null"), keys, value, weight=F.col(weight))
    return beside(sums, sums.groupBy(*keys).agg(F.sum("rows").alias("_t")), keys)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The smallest value at which the cumulative weight reaches half the total; equal values are summed first, in slices of a key."""
    sums = _cumulative_weights(df, keys, value, weight)
    return sums.where(F.col("before") + F.col("rows") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """Linear interpolation between mid-point positions (cumulative weight less half of one's own, over the total), clamped."""
    placed = _cumulative_weights(df, keys, value, weight).withColumn("_p", (F.col("before") + F.col("rows") / 2) / F.col("_t"))
    at = F.struct("_p", F.col(value).alias("_v"))
    ends = placed.groupBy(*keys).agg(F.max(F.when(F.col("_p") <= q, at)).alias("_a"), F.min(F.when(F.col("_p") > q, at)).alias("_b"))
    between = F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * (q - F.col("_a._p")) / (F.col("_b._p") - F.col("_a._p"))
    return ends.select(*keys, F.coalesce(between, F.col("_a._v"), F.col("_b._v")).alias("weighted_quantile"))


def volatility(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The spread of a positive series on the log scale: deviation, median absolute deviation, ratio of extremes."""
    logs = df.where(F.col(value) > 0).withColumn("_l", F.log(value)).select(*keys, value, "_l")
    sums = logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_l").alias("log_std"), (F.max(value) / F.min(value)).alias("max_over_min"))
    return beside(sums, absolute_deviation(logs, keys, "_l").select(*keys, F.col("deviation").alias("log_mad")), keys)


def absolute_deviation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median (centre) and the median absolute deviation from it (deviation), for keys of any size."""
    centres = quantiles(df, keys, value, {"centre": 0.5})
    away = beside(df.select(*keys, F.col(value).alias("_x")), centres, keys).select(*keys, F.abs(F.col("_x") - F.col("centre")).alias("_away"))
    return beside(centres, quantiles(away, keys, "_away", {"deviation": 0.5}), keys)


def robust_scale(df: DataFrame, keys: list[str], value: str, least: float = 1e-6) -> DataFrame:
    """Median and scaled absolute deviation; where that vanishes, the standard deviation; where that does too, 1."""
    spread = beside(absolute_deviation(df, keys, value), df.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd")), keys).withColumn("_mad", MAD_SCALE * F.col("deviation"))
    scale = F.when(F.col("_mad") >= least, F.col("_mad")).when(F.col("_sd") >= least, F.col("_sd")).otherwise(1.0)
    return spread.select(*keys, "centre", scale.alias("scale"))


def staged_median(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """The median over groups of the medians inside them."""
    return df.groupBy(*inner).agg(F.median(value).alias("_m")).groupBy(*outer).agg(F.median("_m").alias("median_of_medians"), F.count(F.lit(1)).alias("groups"))


def equal_cluster_mean(df: DataFrame, cluster: str, value: str, keys: list[str] = ()) -> DataFrame:
    """The mean of cluster means: each cluster counts once, whatever its size."""
    return df.groupBy(*keys, cluster).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias("equal_cluster_mean"), F.count(F.lit(1)).alias("clusters"))


def trimmed_log_mean(df: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """The geometric mean without max(1, floor(share * n)) values at either end; of equal values at an end as many go as must."""
    counts = cumulative_counts(df.where(F.col(value) > 0), keys, value)
    sized = counts.join(counts.groupBy(*keys).agg(F.sum("rows").alias("_n")), keys)
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    left = F.greatest(F.lit(0), F.least(F.col("before") + F.col("rows"), F.col("_n") - cut) - F.greatest(F.col("before"), cut))
    return sized.withColumn("_k", left).where("_k > 0").groupBy(*keys).agg(F.exp(F.sum(F.col("_k") * F.log(value)) / F.sum("_k")).alias("trimmed_mean"), F.sum("_k").alias("kept"))


def jackknife(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The lowest and highest log-mean that leaving one row out gives, from group totals."""
    sums = df.where(F.col(value) > 0).groupBy(*keys).agg(F.sum(F.log(value)).alias("_s"), F.count(F.lit(1)).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    left = lambda c: F.exp((F.col("_s") - F.log(c)) / (F.col("n") - 1))
    return sums.where("n > 1").select(*keys, "n", F.exp(F.col("_s") / F.col("n")).alias("center"), left("_hi").alias("lowest"), left("_lo").alias("highest"))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 of each distinct value, equal values sharing the mean of theirs."""
    return cumulative_counts(df, keys, value).select(*keys, value, (F.col("before") + (F.col("rows") + 1) / 2).alias(name))


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson on the values and on logs, and Spearman with average ranks, from counts of distinct pairs."""
    pairs = df.where(f"{x} is not null and {y} is not null").groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_c"))
    rows = df.where(f"{x} is not null and {y} is not null")
    ranked = pairs.join(average_ranks(rows, keys, x, "_x"), [*keys, x]).join(average_ranks(rows, keys, y, "_y"), [*keys, y])
    plain = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr(*(F.when((F.col(x) > 0) & (F.col(y) > 0), F.log(c)) for c in (x, y))).alias("log_pearson"))
    middle = (F.sum("_c") + 1) / 2  # the mean of all ranks
    c, a, b = F.col("_c"), F.col("_x"), F.col("_y")
    spread = lambda p: F.sum(c * p) - F.sum(c) * middle * middle
    spearman = ranked.groupBy(*keys).agg((spread(a * b) / F.sqrt(spread(a * a) * spread(b * b))).alias("spearman"))
    return plain.join(spearman, keys)


def regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r squared and the slope's standard error and t, from one pass of sums."""
    sums = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_xx"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy")
    )
    residual = F.greatest(F.lit(0.0), F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx"))
    error = F.sqrt(residual / (F.col("n") - 2) / F.col("_xx"))
    return sums.where("n > 2 and _xx > 0").withColumn("stderr", error).select(*keys, "n", "slope", "intercept", "r2", "stderr", F.when(F.col("stderr") > 0, F.col("slope") / F.col("stderr")).alias("t"))


def weighted_vote(df: DataFrame, key: str, label: str, weight: str) -> DataFrame:
    """The label with the most weight; ties to the smaller label."""
    sums = df.groupBy(key, label).agg(F.sum(weight).alias("votes"))
    best = Window.partitionBy(key).orderBy(F.desc("votes"), F.asc(label))
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def coverage(df: DataFrame, key: str, entity: str, group: str, least_entities: int, least_groups: int) -> DataFrame:
    """Entities and groups behind each key, and whether both suffice."""
    out = df.groupBy(key).agg(F.count_distinct(entity).alias("entities"), F.count_distinct(group).alias("groups"))
    return out.withColumn("eligible", (F.col("entities") >= least_entities) & (F.col("groups") >= least_groups))


def supported(df: DataFrame, keys: list[str], entity: str, value: str, least_rows: int, least_entities: int) -> DataFrame:
    """Smallest, largest and mean value, nulls left out, of the keys with enough rows and distinct entities behind them."""
    held = df.where(f"{value} is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), F.min(value).alias("smallest"), F.max(value).alias("largest"), F.avg(value).alias("mean")
    )
    return held.where(f"rows >= {least_rows} and entities >= {least_entities}")


def inconstant(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Groups whose rows disagree on a field, with the number of its values (null is one)."""
    counted = [(F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f"{f}_values") for f in fields]
    return df.groupBy(*keys).agg(*counted).where(" or ".join(f"{f}_values > 1" for f in fields))


def collapse(df: DataFrame, keys: list[str], policies: dict[str, str]) -> DataFrame:
    """One row a group, each column by a policy: max, min, mean, median or sum."""
    named = {"max": F.max, "min": F.min, "mean": F.avg, "median": F.median, "sum": F.sum}
    return df.groupBy(*keys).agg(*(named[p](c).alias(c) for c, p in policies.items()), F.count(F.lit(1)).alias("collapsed"))


def set_digest(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """A digest of each group's set of items that any order and repetition leave alone.

    Items' digests are summed as numbers, so that no group is collected; distinct items come first.
    """
    halves = df.select(*keys, F.sha2(F.col(item).cast("string"), 256).alias("_d")).distinct()
    part = lambda a: F.sum(F.conv(F.substring("_d", a, 8), 16, 10).cast("decimal(38,0)"))
    return halves.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), part(1).alias("digest_a"), part(9).alias("digest_b"))


def win_rate(df: DataFrame, keys: list[str], ours: str, theirs: str) -> DataFrame:
    """The share of rows on which one error is strictly smaller than the other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(ours) < F.abs(theirs)).cast("double")).alias("win_rate"))


def long_form(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric that has a value."""
    return df.unpivot(ids, metrics, "metric", "value").where("value is not null")


def normalised_index(df: DataFrame, fine: str, coarse: str, entity: str, value: str, least: int) -> DataFrame:
    """Entities' geometric index after removing the median of (coarse, fine) with enough rows, else of coarse, else of fine, else of all."""
    logs = df.where(F.col(value) > 0).select(entity, coarse, fine, F.log(value).alias("_l"))
    levels = [([coarse, fine], "_a"), ([coarse], "_b"), ([fine], "_c")]
    sizes = {name: logs.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}n")) for keys, name in levels}
    medians = {name: beside(sizes[name], quantiles(logs, keys, "_l", {name: 0.5}), keys) for keys, name in levels}
    table = medians["_a"].join(medians["_b"], coarse).join(medians["_c"], fine).crossJoin(quantiles(logs, [], "_l", {"_d": 0.5}))  # one row
    base = F.col("_d")
    for _, name in reversed(levels):
        base = F.when(F.col(f"{name}n") >= least, F.col(name)).otherwise(base)
    bases = table.select(coarse, fine, base.alias("_base"))
    return logs.join(bases, [coarse, fine]).groupBy(entity).agg(F.exp(F.median(F.col("_l") - F.col("_base"))).alias("index"), F.count(F.lit(1)).alias("n"))
