"""Nested cross-validation from sums: the policy of each outer fold is chosen inside its training rows, and nothing is fitted twice from rows.

An outer fold leaves one group out, and with a period also all rows of its own and later periods. Inside, each other group is left out
in turn. The training sums of a pair of folds are the total less the sums of the two groups (inclusion and exclusion), where with
periods totals and groups' sums are running ones. The mean squared error of a left-out group is a quadratic form in its own sums. So rows are read
twice: to be added up by (group, period), and to be predicted once by the policy chosen for their fold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.linear import complete, product_sums, sum_names
from tidemark.session import materialize, ship

Policy = tuple[tuple[str, ...], float]


def _matrices(frame: pd.DataFrame, prefix: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of the features (0 is the constant) and products with the outcome, of each row of sums."""
    square = np.empty((len(frame), k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            square[:, i, j] = square[:, j, i] = frame[f"{prefix}s{i}_{j}"]
    return square, frame[[f"{prefix}t{i}" for i in range(k + 1)]].to_numpy()


def _coefficients(square: np.ndarray, outcome: np.ndarray, chosen: list[int], penalty: float) -> np.ndarray:
    """Coefficients of the constant and the chosen features for each system, zero for the others; the constant isn't penalised."""
    held = [0, *chosen]
    a = square[:, held][:, :, held].copy()
    inner = np.arange(1, len(held))
    a[:, inner, inner] += penalty
    out = np.zeros(outcome.shape)
    out[:, held] = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), outcome[:, held])
    return out


def _places(policies: list[Policy], features: list[str]) -> list[tuple[list[int], float]]:
    return [([features.index(f) + 1 for f in chosen], penalty) for chosen, penalty in policies]


def _running(sums: DataFrame, group: str, period: str, names: list[str]) -> DataFrame:
    """(group, period) with the group's sums over strictly earlier periods, for every group and every period there is."""
    periods = sums.agg(F.collect_set(period).alias("_p"))  # one row
    grid = sums.select(group).distinct().crossJoin(periods).select(group, F.explode("_p").alias(period))
    past = Window.partitionBy(group).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(sums, [group, period], "left").fillna(0, names)
    return filled.select(group, period, *(F.coalesce(F.sum(c).over(past), F.lit(0.0)).alias(c) for c in names))


def nested_selection(
    df: DataFrame, group: str, features: list[str], y: str, policies: list[Policy], period: str | None = None, least_rows: int = 1, least_groups: int = 2, tolerance: float = 0.0
) -> DataFrame:
    """One row for each outer fold (group, and period if given): the policy chosen inside, its inner loss, and the fold's own error.

    A policy names its features and its penalty. Its inner loss is the mean over left-out groups of their mean squared errors. Of all policies within
    `tolerance` of the least loss the largest penalty wins, then the first in the list. Inner and outer fits need `least_rows` training rows
    of `least_groups` groups; an outer fold in which no inner fit has them is left out. Rows with a null field don't count.
    Columns: policy (its place), inner_loss, inner_groups, train_rows, tests, mean_abs_error.
    """
    k, place = len(features), period or "_period"
    rows = complete(df, [*features, y]).withColumn(place, F.col(period) if period else F.lit(0))
    names = [*sum_names(k), "yy"]
    sums = materialize(rows.groupBy(group, place).agg(*product_sums(features, y), F.sum(F.col(y) * F.col(y)).alias("yy")))
    held = materialize(_running(sums, group, place, names)) if period else sums
    totals = held.groupBy(place).agg(*(F.sum(c).alias(f"a_{c}") for c in names), F.sum((F.col("n") > 0).cast("int")).alias("_groups"))
    own = held.select(group, place, *(F.col(c).alias(f"o_{c}") for c in names))
    outer = sums.select(group, place).join(own, [group, place]).join(totals, place)
    outer = outer.withColumn("_groups", F.col("_groups") - (F.col("o_n") > 0).cast("int"))
    train = lambda *out: [reduce(lambda a, b: a - b, (F.col(f"{o}{c}") for o in out), F.col(f"a_{c}")).alias(c) for c in names]
    outer = materialize(outer.select(group, place, "_groups", *train("o_")).where((F.col("n") >= least_rows) & (F.col("_groups") >= least_groups)))

    inside = held.where("n > 0").select(F.col(group).alias("_h"), place, *(F.col(c).alias(f"v_{c}") for c in names))
    pairs = outer.select(group, place, "_groups", *(F.col(c).alias(f"a_{c}") for c in names)).join(inside, place).where(F.col(group) != F.col("_h"))
    pairs = pairs.select(group, place, *train("v_"), *(f"v_{c}" for c in names)).where(F.col("n") >= least_rows)
    pairs = pairs if least_groups <= 1 else pairs.join(outer.where(F.col("_groups") - 1 >= least_groups).select(group, place), [group, place], "left_semi")
    graded = _by_policy(pairs, [group, place], k, _places(policies, features)).groupBy(group, place, "policy").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("inner_groups"))
    penalties = F.array(*(F.lit(float(p)) for _, p in policies))
    ranked = graded.withColumn("_near", F.col("loss") <= F.min("loss").over(Window.partitionBy(group, place)) + tolerance)
    best = ranked.where("_near").groupBy(group, place).agg(F.min(F.struct((-F.get(penalties, F.col("policy"))).alias("_p"), "policy", "loss", "inner_groups")).alias("_b"))
    chosen = best.select(group, place, F.col("_b.policy").alias("policy"), F.col("_b.loss").alias("inner_loss"), F.col("_b.inner_groups").alias("inner_groups"))

    fits = _fitted(outer.join(chosen, [group, place]), [group, place], k, _places(policies, features))
    tested = rows.join(fits, [group, place])
    error = F.abs(reduce(lambda a, b: a + b, (F.col(f"b{i}") * F.col(f) for i, f in enumerate(features, 1)), F.col("b0")) - F.col(y))
    ends = tested.groupBy(group, place).agg(F.count(F.lit(1)).alias("tests"), F.avg(error).alias("mean_abs_error"))
    out = chosen.join(outer.select(group, place, F.col("n").cast("long").alias("train_rows")), [group, place]).join(ends, [group, place])
    return out if period else out.drop(place)


def _by_policy(pairs: DataFrame, keys: list[str], k: int, policies: list[tuple[list[int], float]]) -> DataFrame:
    """(keys, policy, loss) of each pair of folds: the mean squared error, on the inner group's sums, of the fit on the training sums."""
    ship(pairs.sparkSession)

    def run(frames):
        for frame in frames:
            square, outcome = _matrices(frame, "", k)
            v_square, v_outcome = _matrices(frame, "v_", k)
            for at, (chosen, penalty) in enumerate(policies):
                b = _coefficients(square, outcome, chosen, penalty)
                error = frame["v_yy"].to_numpy() - 2 * np.einsum("ni,ni->n", b, v_outcome) + np.einsum("ni,nij,nj->n", b, v_square, b)
                yield frame[keys].assign(policy=np.int32(at), loss=np.maximum(error, 0.0) / frame["v_n"].to_numpy())

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keys)
    return pairs.mapInPandas(run, f"{kinds}, policy int, loss double")


def _fitted(outer: DataFrame, keys: list[str], k: int, policies: list[tuple[list[int], float]]) -> DataFrame:
    """(keys, b0, b1, ...) of each outer fold under its policy."""
    ship(outer.sparkSession)

    def run(frames):
        for frame in frames:
            square, outcome = _matrices(frame, "", k)
            b = np.zeros(outcome.shape)
            for at, (chosen, penalty) in enumerate(policies):
                mine = frame["policy"].to_numpy() == at
                b[mine] = _coefficients(square[mine], outcome[mine], chosen, penalty)
            yield frame[keys].assign(**{f"b{i}": b[:, i] for i in range(k + 1)})

    kinds = ", ".join(f"{c} {outer.schema[c].dataType.simpleString()}" for c in keys)
    return outer.mapInPandas(run, kinds + "".join(f", b{i} double" for i in range(k + 1)))
