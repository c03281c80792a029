"""Regressions from sums: what a fit needs is added up by Spark, so that no fold reads its training rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUMS = ("_n", "_x", "_y", "_xx", "_xy")


def _sums(x: str, y: str) -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [F.count(F.lit(1)).cast("double").alias("_n"), F.sum(a).alias("_x"), F.sum(b).alias("_y"), F.sum(a * a).alias("_xx"), F.sum(a * b).alias("_xy")]


def _slope(n: Column, sx: Column, sy: Column, xx: Column, xy: Column) -> Column:
    spread = n * xx - sx * sx
    return F.when(spread > 1e-9, (n * xy - sx * sy) / spread)


def walk_forward(df: DataFrame, group: str, day: str, x: str, y: str, least: int) -> DataFrame:
    """Each row's prediction from a line through all rows of strictly earlier days and other groups.

    Sums are kept by (group, day). What a test needs is the total of earlier days less its own group's part of it, so
    the plan is two running sums and joins on keys, without a join of rows to their training rows. The running total
    goes over the distinct days only, whose number doesn't grow with the rows.
    """
    cells = df.groupBy(group, day).agg(*_sums(x, y))
    days = cells.groupBy(day).agg(*(F.sum(c).alias(c) for c in _SUMS))
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    past = days.select(day, *(F.sum(c).over(before).alias(f"a{c}") for c in _SUMS))
    own = Window.partitionBy(group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    mine = cells.select(group, day, *(F.coalesce(F.sum(c).over(own), F.lit(0.0)).alias(f"g{c}") for c in _SUMS))
    train = [F.col(f"a{c}") - F.col(f"g{c}") for c in _SUMS]
    lines = mine.join(past, day).select(group, day, train[0].cast("long").alias("train_rows"), _slope(*train).alias("slope"), *(v.alias(c) for v, c in zip(train, _SUMS)))
    fits = lines.where(f"train_rows >= {least} and slope is not null").select(group, day, "train_rows", "slope", ((F.col("_y") - F.col("slope") * F.col("_x")) / F.col("_n")).alias("intercept"))
    out = df.join(fits, [group, day]).withColumn("predicted", F.col("intercept") + F.col("slope") * F.col(x))
    return out.withColumn("error", F.col("predicted") - F.col(y))


def leave_one_group_out(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Of each group, the line through all others and its mean absolute error on the group."""
    cells = df.groupBy(group).agg(*_sums(x, y))
    total = cells.agg(*(F.sum(c).alias(f"a{c}") for c in _SUMS))
    train = [F.col(f"a{c}") - F.col(c) for c in _SUMS]
    fits = cells.crossJoin(F.broadcast(total)).select(group, _slope(*train).alias("slope"), *(v.alias(f"t{c}") for v, c in zip(train, _SUMS)))
    lines = fits.select(group, "slope", ((F.col("t_y") - F.col("slope") * F.col("t_x")) / F.col("t_n")).alias("intercept"))
    error = F.abs(F.col("intercept") + F.col("slope") * F.col(x) - F.col(y))
    return df.join(lines, group).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.first("slope").alias("slope"), F.avg(error).alias("mean_abs_error"))


def within_group_slope(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """The common slope after taking out each group's means, from group sums."""
    cells = df.groupBy(group).agg(*_sums(x, y))
    xy = F.sum(F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_n"))
    xx = F.sum(F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_n"))
    return cells.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").cast("long").alias("n"), (xy / xx).alias("slope"))
