"""Weight choices, intervals, scenarios and comparisons of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import beside, cumulative_counts, quantiles
from tidemark.plans.resampling import digest_number, drawn, numbered

LOG10_E = 0.4342944819032518


def weight_search(df: DataFrame, predictors: list[str], actual: str, steps: int) -> DataFrame:
    """For each objective (mse, mae, median and p80 of absolute errors) the best weights on a grid of the simplex.

    A row's weights are spread anew over the predictors it has; rows without any weight on one they have count nothing. The
    grid's size is fixed by `steps`, so rows are unfolded by it, and each grid point keeps partial sums and percentiles. Ties go to
    the first vector.
    """
    vectors = [[a, *rest] for a in range(steps + 1) for rest in _rests(steps - a, len(predictors) - 1)]
    grid = F.explode(F.array(*(F.array(*map(F.lit, v)) for v in vectors))).alias("weights")
    rows = df.where(f"{actual} is not null").select(*predictors, actual, grid)
    held = [F.when(F.col(p).isNotNull(), F.col("weights")[i]).otherwise(0) for i, p in enumerate(predictors)]
    total = reduce(lambda a, b: a + b, held)
    blend = reduce(lambda a, b: a + b, (h * F.coalesce(F.col(p), F.lit(0.0)) for h, p in zip(held, predictors))) / F.nullif(total, F.lit(0))
    size = F.abs(F.col("_blend") - F.col(actual))
    losses = rows.withColumn("_blend", blend).where("_blend is not null").groupBy("weights").agg(F.avg(size * size).alias("mse"), F.avg(size).alias("mae"), F.median(size).alias("median"), F.percentile(size, F.lit(0.8)).alias("p80"))
    named = losses.select("weights", F.explode(F.create_map(*(x for o in ("mse", "mae", "median", "p80") for x in (F.lit(o), F.round(o, 9))))).alias("objective", "loss"))
    best = named.groupBy("objective").agg(F.min(F.struct("loss", "weights")).alias("_b"))
    return best.select("objective", *(F.col("_b.weights")[i].alias(f"w{i}") for i in range(len(predictors))), F.col("_b.loss").alias("loss"))


def _rests(left: int, parts: int) -> list[list[int]]:
    return [[left]] if parts == 1 else [[a, *rest] for a in range(left + 1) for rest in _rests(left - a, parts - 1)]


def nested_blend(df: DataFrame, group: str, first: str, second: str, actual: str, steps: int = 20) -> DataFrame:
    """Each group's error under the blend weight that is best for all others: sums by (group, weight), totals less its own."""
    weights = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("w")
    rows = df.where(f"{first} is not null and {second} is not null and {actual} is not null").select(group, first, second, actual, weights)
    loss = F.abs(F.col("w") / steps * F.col(first) + (1 - F.col("w") / steps) * F.col(second) - F.col(actual))
    cells = rows.groupBy(group, "w").agg(F.sum(loss).alias("_s"), F.count(F.lit(1)).alias("_n"))
    total = cells.groupBy("w").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    others = cells.join(total, "w").withColumn("_loss", F.round((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n")), 9))
    best = others.groupBy(group).agg(F.min(F.struct("_loss", "w", "_s", "_n")).alias("_b"))
    return best.select(group, (F.col("_b.w") / steps).alias("weight"), (F.col("_b._s") / F.col("_b._n")).alias("mean_abs_error"))


def weight_bootstrap(df: DataFrame, group: str, first: str, second: str, actual: str, draws: int, seed: int, steps: int = 20) -> DataFrame:
    """How often each blend weight is the best one when groups are resampled: sums by (group, weight) meet the draws, rows don't."""
    weights = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("w")
    loss = F.pow(F.col("w") / steps * F.col(first) + (1 - F.col("w") / steps) * F.col(second) - F.col(actual), F.lit(2.0))
    cells = df.select(group, first, second, actual, weights).groupBy(group, "w").agg(F.sum(loss).alias("_s"), F.count(F.lit(1)).alias("_n"))
    names = numbered(df.select(group).distinct(), [], group)
    picked = drawn(names, draws, seed).join(names.select("_k", group), "_k")
    losses = picked.join(cells, group).groupBy("draw", "w").agg(F.round(F.sum("_s") / F.sum("_n"), 9).alias("_l"))
    best = losses.groupBy("draw").agg(F.min(F.struct("_l", "w")).alias("_b"))
    return best.groupBy((F.col("_b.w") / steps).alias("weight")).agg(F.count(F.lit(1)).alias("draws"))


def two_level_bootstrap(df: DataFrame, cluster: str, row: str, value: str, draws: int, seed: int) -> DataFrame:
    """Clusters are drawn, then rows inside each drawn cluster; the mean of cluster means, with its 5 % to 95 % interval.

    Rows are numbered inside their cluster by `row`. The work is rows times draws, since each draw takes rows anew.
    """
    held = df.where(f"{value} is not null").select(cluster, row, value)
    rows = numbered(held, [cluster], row, "_r", "_size")
    sizes = numbered(rows.select(cluster, "_size").distinct(), [], cluster)
    picked = drawn(sizes, draws, seed).join(sizes.select("_k", cluster, "_size"), "_k")
    inner = picked.select("draw", "slot", cluster, "_size", F.explode(F.sequence(F.lit(0), F.col("_size").cast("int") - 1)).alias("place"))
    taken = inner.withColumn("_r", (digest_number(F.lit(seed), F.col("draw"), F.col("slot"), F.col("place")) % F.col("_size")).cast("int"))
    means = taken.join(rows.select(cluster, "_r", value), [cluster, "_r"]).groupBy("draw", "slot").agg(F.avg(value).alias("_v")).groupBy("draw").agg(F.avg("_v").alias("_v"))
    return means.agg(F.count(F.lit(1)).alias("draws"), F.avg("_v").alias("mean"), F.percentile("_v", F.lit(0.05)).alias("low"), F.percentile("_v", F.lit(0.95)).alias("high"))


def factor_envelope(df: DataFrame, specifications: list[str], size: str, coverage: float) -> DataFrame:
    """The ceil((n + 1) * coverage)-th smallest error of each specification, and the largest of them over all.

    Errors are counted by value first, so that ranks are running sums over distinct values.
    """
    counts = cumulative_counts(df.where(f"{size} is not null"), specifications, size).withColumn("_upto", F.col("before") + F.col("rows"))
    ranked = beside(counts, counts.groupBy(*specifications).agg(F.sum("rows").alias("n")), specifications)
    reached = ranked.withColumn("rank", F.ceil((F.col("n") + 1) * F.lit(coverage)).cast("long")).where("_upto >= rank")
    each = reached.groupBy(*specifications, "n", "rank").agg(F.min(size).alias("factor"))
    return each.crossJoin(each.agg(F.max("factor").alias("envelope")))  # the envelope is one row


def coverage_rates(df: DataFrame, group: str, day: str, hit: str) -> DataFrame:
    """Three hit rates: of all tests, of groups alike, and of the latest test of each group (all tests of its last day)."""
    scored = df.withColumn("_h", F.col(hit).cast("double"))
    by_day = scored.groupBy(group, day).agg(F.sum("_h").alias("_s"), F.count(F.lit(1)).alias("_n"))
    by_group = by_day.groupBy(group).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.max(F.struct(day, (F.col("_s") / F.col("_n")).alias("_r"))).alias("_l"))
    return by_group.agg(F.sum("_n").alias("tests"), (F.sum("_s") / F.sum("_n")).alias("raw_rate"), F.avg(F.col("_s") / F.col("_n")).alias("group_balanced_rate"), F.avg("_l._r").alias("latest_rate"))


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from the digest of the parts."""
    return (digest_number(*parts) + 0.5) / float(1 << 32)


def split_half_normal(df: DataFrame, keys: list[str], centre: str, low: str, high: str, draws: int, seed: int) -> DataFrame:
    """Draws around a centre whose sides have their own spread: normal sizes by Box and Muller from digests, either side alike often.

    `low` and `high` are the ends of an interval of one deviation. Draws don't depend on partitions.
    """
    each = df.select(*keys, centre, low, high, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = [uniform(F.lit(seed + i), *map(F.col, keys), F.col("draw")) for i in range(3)]
    size = F.abs(F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1]))
    drawn = F.when(u[2] < 0.5, F.col(centre) - size * (F.col(centre) - F.col(low))).otherwise(F.col(centre) + size * (F.col(high) - F.col(centre)))
    return each.select(*keys, "draw", drawn.alias("value"))


def quantile_function(p: Column, knots: list[tuple[float, Column]]) -> Column:
    """A quantile function through known (level, value) points, straight between them on the log scale and flat outside."""
    out = knots[-1][1]
    for (p0, v0), (p1, v1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(p <= p1, F.exp(F.log(v0) + (p - p0) / (p1 - p0) * (F.log(v1) - F.log(v0)))).otherwise(out)
    return F.when(p <= knots[0][0], knots[0][1]).otherwise(out)


def doubling_time(frontier: DataFrame, keys: list[str], years: str, value: str) -> DataFrame:
    """The yearly slope of the base-2 logarithm along a frontier, its growth factor a year, and the years it takes to double."""
    fits = frontier.where(f"{value} > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.regr_slope(F.log2(value), years).alias("slope"))
    return fits.where("slope is not null").select(*keys, "points", "slope", F.pow(F.lit(2.0), F.col("slope")).alias("growth"), F.when(F.col("slope") > 0, 1 / F.col("slope")).alias("doubling_years"))


def anchored(anchor: Column, score_slope: Column, score_gap: Column, date_slope: Column, years: Column) -> Column:
    """An anchor's value moved by differences of score and date on the base-10 log scale."""
    return anchor * F.pow(F.lit(10.0), score_slope * score_gap + date_slope * years)


def transported(df: DataFrame, keys: list[str], x: str, part: str, whole: str, out: str = "whole_predicted") -> DataFrame:
    """Predict a part from x, predict the ratio whole to part from x, and multiply; both lines on the log scale."""
    logs = df.where(f"{part} > 0 and {whole} > 0").withColumn("_p", F.log(part)).withColumn("_q", F.log(F.col(whole) / F.col(part)))
    fits = logs.groupBy(*keys).agg(*(f(c, x).alias(n) for c, a in (("_p", "p"), ("_q", "q")) for f, n in ((F.regr_slope, f"_{a}s"), (F.regr_intercept, f"_{a}i"))))
    joined = df.join(fits, keys)
    return joined.withColumn("part_predicted", F.exp(F.col("_pi") + F.col("_ps") * F.col(x))).withColumn("ratio_predicted", F.exp(F.col("_qi") + F.col("_qs") * F.col(x))).withColumn(out, F.col("part_predicted") * F.col("ratio_predicted")).drop("_ps", "_pi", "_qs", "_qi")


def counterfactual_medians(df: DataFrame, keys: list[str], value: str, admitted: Column) -> DataFrame:
    """Medians of the admitted rows and of all, and the ratio of the second to the first."""
    both = df.groupBy(*keys).agg(F.median(F.when(admitted, F.col(value))).alias("own_median"), F.median(value).alias("mixed_median"))
    return both.where("own_median is not null").withColumn("ratio", F.col("mixed_median") / F.col("own_median"))


def scenarios(df: DataFrame, key: str, value: str, changes: dict[str, dict], run) -> DataFrame:
    """`run(df)` as it is and with replaced values, one scenario after another; `run` gives one row (or one per key)."""
    base = run(df).withColumn("scenario", F.lit("base"))
    for name, replaced in changes.items():
        new = F.col(value)
        for k, v in replaced.items():
            new = F.when(F.col(key) == k, F.lit(v)).otherwise(new)
        base = base.unionByName(run(df.withColumn(value, new)).withColumn("scenario", F.lit(name)))
    return base


def percent_change(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each scenario's value and its change from the base in percent."""
    base = results.where("scenario = 'base'").select(*keys, F.col(value).alias("_base"))
    joined = results.join(base, keys) if keys else results.crossJoin(base)  # without keys the base is one row
    return joined.withColumn("change_percent", 100 * (F.col(value) / F.col("_base") - 1)).drop("_base")


def composite_index(df: DataFrame, entity: str, task: str, value: str, train: Column) -> DataFrame:
    """The mean over tasks of an entity's deviations, with each task's mean and population deviation from training rows."""
    scales = df.where(train).groupBy(task).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_d"))
    z = F.when(F.col("_d") > 0, (F.col(value) - F.col("_m")) / F.col("_d"))
    return df.join(scales, task).withColumn("_z", z).groupBy(entity).agg(F.avg("_z").alias("index"), F.count("_z").alias("tasks"))


def matched_pairs(df: DataFrame, keys: list[str], treated: Column, value: str, label: str) -> DataFrame:
    """Of each key the best row of either class (ties to the smaller label), where both are there, and the uplift."""
    best = lambda c: F.min(F.when(c, F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))))
    pairs = df.where(f"{value} is not null").groupBy(*keys).agg(best(treated).alias("_t"), best(~treated).alias("_u")).where("_t is not null and _u is not null")
    return pairs.select(*keys, F.col("_t.l").alias("treated"), F.col("_u.l").alias("untreated"), (F.col("_u.v") - F.col("_t.v")).alias("uplift"))


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Two tables of predictions, key by key: in both alike, in both apart, or in one only."""
    joined = a.select(*keys, F.col(value).alias("first")).join(b.select(*keys, F.col(value).alias("second")), keys, "full")
    status = F.when(F.col("first").isNull(), "second only").when(F.col("second").isNull(), "first only").when(F.abs(F.col("first") - F.col("second")) <= tolerance, "same").otherwise("changed")
    return joined.withColumn("status", status)


def support(df: DataFrame, keys: list[str], train: Column, feature: str) -> DataFrame:
    """Whether a row lies beyond its key's training rows, and how far beyond the largest one as a ratio."""
    tops = df.where(train).groupBy(*keys).agg(F.max(feature).alias("_top"))
    return df.join(tops, keys, "left").withColumn("beyond", F.coalesce(F.col(feature) > F.col("_top"), F.lit(True))).withColumn("extrapolation", F.col(feature) / F.col("_top")).drop("_top")


def calibrated(df: DataFrame, anchor: Column, actual: str, estimate: str) -> DataFrame:
    """All estimates times the geometric mean of actual to estimate over the anchors."""
    held = anchor & (F.col(actual) > 0) & (F.col(estimate) > 0)
    factor = df.where(held).agg(F.exp(F.avg(F.log(F.col(actual) / F.col(estimate)))).alias("factor"))
    return df.crossJoin(factor).withColumn("calibrated", F.col(estimate) * F.col("factor"))  # the factor is one row


def error_band(df: DataFrame, held_out: Column, error: str, central: str, quantile: float = 0.8) -> DataFrame:
    """A central value divided and multiplied by ten to the quantile of held-out absolute log10 errors."""
    sizes = df.where(held_out).select(F.abs(F.col(error)).alias("_size"))
    factor = quantiles(sizes, [], "_size", {"_f": quantile}).select(F.pow(F.lit(10.0), F.col("_f")).alias("_f"))
    return df.crossJoin(factor).withColumn("low", F.col(central) / F.col("_f")).withColumn("high", F.col(central) * F.col("_f")).drop("_f")  # one row
