"""The best blend weights on a fine grid of the simplex, by bounds instead of by trying every point on every row.

The mean squared error of all points follows from sums of products, one set for each pattern of missing predictors. For the mean,
median and 80th percentile of absolute errors the grid is cut into boxes. In a box a row's blend stays between its extremes over the box's
corners, so its absolute error has a lower bound; tasks add these up, or count those under the best loss known so far. Boxes that
can't hold a better point are dropped, the others are halved in every direction until single points are left, which are exact.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quantiles
from tidemark.session import discard, materialize, ship

LEVELS = {"median": 0.5, "p80": 0.8}
#: Losses are compared to nine digits, so that ties go to the first vector.
DIGITS = 9
SLACK = 10.0**-DIGITS
#: Cells of a block of rows times boxes inside a task.
BLOCK = 1_000_000
FIRST_WIDTH = 8
#: Of how many promising boxes a round tries a point, for each objective.
TRIED = 5


def grid_points(steps: int, parts: int) -> np.ndarray:
    """All vectors of whole numbers that add up to `steps`, in order."""
    return np.array([(*p, steps - sum(p)) for p in product(range(steps + 1), repeat=parts - 1) if sum(p) <= steps], dtype=np.int64)


def _boxes(points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of a width that hold any of the points: bounds of every weight but the last."""
    low = np.unique(points[:, :-1] // width * width, axis=0)
    return low, low + width - 1


def least_errors(values: np.ndarray, held: np.ndarray, actual: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int) -> np.ndarray:
    """Lower bounds (rows x boxes) of the absolute errors of blends whose weights but the last lie in a box; missing predictors count nothing.

    The last weight is what the others leave. A blend is a ratio of linear forms, so its extremes over a box are at corners wherever
    the weights that a row has add up to more than nothing all over the box; where they don't, the bound is zero.
    """
    least, most = np.full((len(values), len(low)), np.inf), np.full((len(values), len(low)), -np.inf)
    sound = np.ones(least.shape, dtype=bool)
    ends = held[:, -1:] > 0
    for corner in product((False, True), repeat=low.shape[1]):
        weights = np.where(corner, high, low).astype(np.float64)
        weights = np.column_stack([weights, steps - weights.sum(axis=1)]).T
        total = held @ weights
        with np.errstate(invalid="ignore", divide="ignore"):
            blend = values @ weights / np.where(total > 0, total, np.nan)
        sound &= (total > 0) | ~ends  # without the last weight, a corner of no weight is a limit of others
        np.fmin(least, blend, out=least), np.fmax(most, blend, out=most)
    return np.where(sound, np.maximum(0.0, np.maximum(least - actual[:, None], actual[:, None] - most)), 0.0)


def _bound_sums(rows: DataFrame, predictors: list[str], low: np.ndarray, high: np.ndarray, steps: int, thresholds: dict[str, float]) -> np.ndarray:
    """For each box the sum of its rows' bounds, and how many lie under each threshold."""
    names = list(thresholds)

    def run(batches):
        out = np.zeros((len(low), 1 + len(names)))
        size = max(1, BLOCK // len(low))
        for part in batches:
            columns = [part.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(predictors) + 1)]
            values = np.column_stack(columns[:-1])
            held = (~np.isnan(values)).astype(np.float64)
            values = np.nan_to_num(values)
            for at in range(0, len(values), size):
                cut = slice(at, at + size)
                errors = least_errors(values[cut], held[cut], columns[-1][cut], low, high, steps)
                out[:, 0] += errors.sum(axis=0)
                for k, name in enumerate(names, 1):
                    out[:, k] += (errors < thresholds[name] - SLACK).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), *(pa.array(out[:, k]) for k in range(1 + len(names)))], names=["box", "mae", *names])

    ship(rows.sparkSession)
    schema = "box int, mae double" + "".join(f", {n} double" for n in names)
    found = rows.mapInArrow(run, schema).groupBy("box").agg(*(F.sum(c).alias(c) for c in ("mae", *names))).orderBy("box").toPandas()  # a row a box
    return found[["mae", *names]].to_numpy()


def _losses(rows: DataFrame, predictors: list[str], actual: str, points: np.ndarray) -> list[dict[str, float]]:
    """Exact mean, median and 80th percentile of the absolute errors of a few points."""
    vectors = F.posexplode(F.array(*(F.array(*(F.lit(int(w)) for w in p)) for p in points))).alias("point", "_w")
    held = [F.when(F.col(p).isNotNull(), F.col("_w")[i]).otherwise(0) for i, p in enumerate(predictors)]
    add = lambda terms: reduce(lambda a, b: a + b, terms)
    blend = add([h * F.coalesce(F.col(p), F.lit(0.0)) for h, p in zip(held, predictors)]) / add(held)
    errors = rows.select("*", vectors).select("point", F.abs(blend - F.col(actual)).alias("_size"))
    means = errors.groupBy("point").agg(F.avg("_size").alias("mae"))
    found = quantiles(errors, ["point"], "_size", LEVELS, few=True).join(means, "point").orderBy("point").collect()  # a row a point
    return [{name: round(r[name], DIGITS) for name in ("mae", *LEVELS)} for r in found]


def _mean_squares(rows: DataFrame, predictors: list[str], actual: str, points: np.ndarray) -> tuple[np.ndarray, int]:
    """The mean squared error of every point (infinite where some row has no weight), from sums by pattern of missing predictors."""
    k = len(predictors)
    pattern = reduce(lambda a, b: a + b, (F.when(F.col(p).isNotNull(), 1 << i).otherwise(0) for i, p in enumerate(predictors)))
    terms = [*(F.coalesce(F.col(p), F.lit(0.0)) - F.col(actual) for p in predictors)]  # errors, since weights add up to one
    sums = [F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    found = rows.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # at most 2 ** k rows
    total, n = np.zeros(len(points)), sum(r.n for r in found)
    for r in found:
        held = np.array([r.pattern >> i & 1 for i in range(k)])
        weights = points * held
        share = weights.sum(axis=1)
        square = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        with np.errstate(invalid="ignore", divide="ignore"):
            normed = weights / share[:, None]
            total += np.where(share > 0, np.einsum("pi,ij,pj->p", normed, square, normed), np.inf)
    return total / max(n, 1), n


def simplex_search(df: DataFrame, predictors: list[str], actual: str, steps: int = 50) -> DataFrame:
    """(objective, w0, w1, ..., loss, evaluated): for mse, mae, median and p80 the best vector of weights in steps of 1 / `steps`.

    A row's weights are spread anew over the predictors it has. Rows without an outcome or without any predictor don't count; a
    vector that leaves a row without weight is not valid. Ties go to the first vector. `evaluated` is the share of all points, as boxes or
    points, that rows were held against. No rows give an empty result.
    """
    spark, k = df.sparkSession, len(predictors)
    present = " or ".join(f"{p} is not null" for p in predictors)
    rows = materialize(df.where(f"{actual} is not null and ({present})").select(*(F.col(c).cast("double").alias(c) for c in (*predictors, actual))))
    points = grid_points(steps, k)
    squares, n = _mean_squares(rows, predictors, actual, points)
    schema = "objective string, " + ", ".join(f"w{i} int" for i in range(k)) + ", loss double, evaluated double"
    valid = np.isfinite(squares)
    points, squares = points[valid], np.round(squares[valid], DIGITS)
    if not n or not len(points):
        return spark.createDataFrame([], schema)
    best = {"mse": (float(squares.min()), tuple(points[squares.argmin()]))}
    known: dict[tuple, dict[str, float]] = {}

    def learn(asked: list[tuple]) -> None:
        new = [p for p in dict.fromkeys(asked) if p not in known]
        for first in range(0, len(new), 64):
            known.update(zip(new[first : first + 64], _losses(rows, predictors, actual, np.array(new[first : first + 64]))))
        for name in ("mae", *LEVELS):
            best[name] = min((found[name], p) for p, found in known.items())

    learn([best["mse"][1]])
    alive, spent, width = {name: points for name in ("mae", *LEVELS)}, 0, FIRST_WIDTH
    while width:
        low, high = _boxes(np.concatenate(list(alive.values())), width)
        found = _bound_sums(rows, predictors, low, high, steps, {name: best[name][0] for name in LEVELS})
        spent += len(low)
        middle = []
        for at, name in enumerate(("mae", *LEVELS)):
            if name == "mae":
                kept = found[:, 0] / n <= best[name][0] + SLACK
            else:
                kept = found[:, at] > np.floor((n - 1) * LEVELS[name])  # else the quantile of the bounds is no smaller than what is known
            if width == 1 and name != "mae":  # a tie of the best loss counts as well
                kept |= found[:, at] >= np.floor((n - 1) * LEVELS[name])
            inside = {tuple(b) for b in low[kept]}
            mine = np.array([tuple(p) in inside for p in alive[name][:, :-1] // width * width])
            alive[name] = alive[name][mine] if len(mine) else alive[name]
            score = found[:, at] if name == "mae" else -found[:, at]
            for box in low[kept][np.argsort(score[kept], kind="stable")[:TRIED]]:
                own = alive[name][(alive[name][:, :-1] // width * width == box).all(axis=1)]
                middle += [tuple(own[len(own) // 2])] if len(own) else []
        if width > 1:
            learn(middle)
        width //= 2
    last = {tuple(p) for name in ("mae", *LEVELS) for p in alive[name]}
    spent += len(last)
    learn(sorted(last))
    discard(rows)
    share = min(1.0, spent / len(points))
    return spark.createDataFrame([(name, *map(int, p), loss, share) for name, (loss, p) in best.items()], schema)
