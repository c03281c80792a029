"""Blends of estimates on the log scale, weight searches, error bands and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import beside, quantiles


def log_blend(estimates: list[Column], weights: list[float]) -> Column:
    """The weighted geometric mean of the estimates that are there, weights spread anew over them; null if none is."""
    held = [(F.when(e > 0, w).otherwise(0.0), F.when(e > 0, w * F.log(e)).otherwise(0.0)) for e, w in zip(estimates, weights)]
    total, logs = (reduce(lambda a, b: a + b, (h[i] for h in held)) for i in (0, 1))
    return F.when(total > 0, F.exp(logs / total))


def reallocated_weights(df: DataFrame, keys: list[str], factor: str, estimate: str, weight: str) -> DataFrame:
    """Each factor's weight among those of its key that have an estimate, and the key's blended estimate."""
    held = df.where(f"{estimate} > 0 and {weight} > 0")
    total = Window.partitionBy(*keys)
    share = F.col(weight) / F.sum(weight).over(total)
    shared = held.withColumn("live_weight", share)
    return shared.withColumn("blend", F.exp(F.sum(F.col("live_weight") * F.log(estimate)).over(total))).select(*keys, factor, "live_weight", "blend")


def simplex(df: DataFrame, predictors: list[str], actual: str, steps: int) -> DataFrame:
    """All weight vectors on a grid of the simplex with their mean squared error.

    The error is a quadratic form in the weights, so one pass adds up the products of errors and the grid meets one
    row of sums; rows never meet the grid. Use the smallest (mse, then the vector) as the best.
    """
    errors = [F.col(p) - F.col(actual) for p in predictors]
    pairs = [(i, j) for i in range(len(predictors)) for j in range(i, len(predictors))]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(errors[i] * errors[j]).alias(f"e{i}_{j}") for i, j in pairs))
    grid = df.sparkSession.range(steps + 1).withColumnRenamed("id", "w0")
    for k in range(1, len(predictors) - 1):
        used = reduce(lambda a, b: a + b, (F.col(f"w{i}") for i in range(k)))
        grid = grid.withColumn(f"w{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps) - used)))
    last = len(predictors) - 1
    grid = grid.withColumn(f"w{last}", F.lit(steps) - reduce(lambda a, b: a + b, (F.col(f"w{i}") for i in range(last))))
    form = reduce(lambda a, b: a + b, (F.col(f"e{i}_{j}") * F.col(f"w{i}") * F.col(f"w{j}") * (1 if i == j else 2) for i, j in pairs))
    return grid.crossJoin(F.broadcast(sums)).select(*(f"w{k}" for k in range(len(predictors))), (form / (F.col("n") * steps * steps)).alias("mse"))


def winsorised_tail(df: DataFrame, keys: list[str], value: str, reference: float, strengths: list[float]) -> DataFrame:
    """Values above a reference pulled towards it by each strength, the centre never lowered: medians and upper quantiles."""
    centre = quantiles(df, keys, value, {"_m": 0.5})
    levels = F.explode(F.array(*map(F.lit, strengths))).alias("strength")
    limit = F.greatest(F.col("_m"), F.lit(reference))
    pulled = F.when(F.col(value) > limit, F.exp(F.log(value) + F.col("strength") * (F.log(limit) - F.log(value)))).otherwise(F.col(value))
    rows = beside(df.where(f"{value} is not null").select(*keys, value), centre, keys).select("*", levels).select(*keys, "strength", pulled.alias("_p"))
    by = [*keys, "strength"]
    return beside(rows.groupBy(*by).agg(F.avg("_p").alias("mean")), quantiles(rows, by, "_p", {"median": 0.5, "p90": 0.9}), by)


def sequential_coverage(df: DataFrame, group: str, day: str, error: str, factor_log10: float, least: int) -> DataFrame:
    """Of each day and group with enough earlier rows of other groups: tests, hits of a fixed band, and the band's earlier hit rate.

    From counts by (group, day), running sums of all less the group's own; days are few.
    """
    hit = (F.abs(error) <= factor_log10).cast("long")
    cells = df.groupBy(group, day).agg(F.count(F.lit(1)).alias("tests"), F.sum(hit).alias("hits"))
    past = lambda *keys: Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = cells.groupBy(day).agg(F.sum("tests").alias("_t"), F.sum("hits").alias("_h")).select(day, *(F.sum(c).over(past()).alias(f"a{c}") for c in ("_t", "_h")))
    own = cells.select("*", *(F.coalesce(F.sum(c).over(past(group)), F.lit(0)).alias(f"g_{c[0]}") for c in ("tests", "hits")))
    joined = own.join(days, day).withColumn("earlier", F.col("a_t") - F.col("g_t")).where(f"earlier >= {least}")
    return joined.select(group, day, "tests", "hits", "earlier", ((F.col("a_h") - F.col("g_h")) / F.col("earlier")).alias("earlier_rate"))


def promotion_gate(df: DataFrame, keys: list[str], gates: dict[str, Column]) -> DataFrame:
    """All named conditions with their conjunction; a null condition doesn't hold. The weight is zero unless all hold."""
    named = df.select(*keys, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in gates.items()))
    every = reduce(lambda a, b: a & b, (F.col(n) for n in gates))
    return named.withColumn("promoted", every).withColumn("live_weight", F.when(every, 1.0).otherwise(0.0))
