"""Linear fits with several features. Spark adds up weighted products; what is solved is one small system per key.

Sums come first, so that no fit, fold or draw reads its training rows again. Systems are solved in batches of Arrow
rows by the pseudo-inverse, which gives the least coefficients where features depend on each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import quantiles, robust_scale, size_medians
from tidemark.plans.resampling import drawn, numbered
from tidemark.session import discard, materialize, ship


def sum_names(k: int) -> list[str]:
    """The names of a fit's sums: rows, products of features (0 is the constant) and products with the outcome."""
    return ["n", *(f"s{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)), *(f"t{i}" for i in range(k + 1))]


def product_sums(features: list[str], y: str, weight: Column | None = None) -> list[Column]:
    terms = [F.lit(1.0), *map(F.col, features)]
    w, k = F.lit(1.0) if weight is None else weight, len(features)
    products = [w * terms[i] * terms[j] for i in range(k + 1) for j in range(i, k + 1)] + [w * t * F.col(y) for t in terms]
    return [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(p).alias(c) for p, c in zip(products, sum_names(k)[1:]))]


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on which a fit can stand: nothing null or not a number."""
    return df.where(" and ".join(f"{c} is not null and not isnan(cast({c} as double))" for c in columns))


def solve(sums: DataFrame, keys: list[str], k: int, ridge: float | str = 0.0) -> DataFrame:
    """Coefficients b0 (the constant, never penalised) to bk of each row of sums; `ridge` is a number or a column."""
    ship(sums.sparkSession)
    penalty = F.col(ridge) if isinstance(ridge, str) else F.lit(float(ridge))
    asked = sums.select(*keys, *sum_names(k)[1:], penalty.alias("_ridge"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields[: len(keys)]] + [f"b{i} double" for i in range(k + 1)])

    def run(frames):
        for frame in frames:
            a = np.zeros((len(frame), k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i, k + 1):
                    a[:, i, j] = a[:, j, i] = frame[f"s{i}_{j}"]
            inner = np.arange(1, k + 1)
            a[:, inner, inner] += frame["_ridge"].to_numpy()[:, None]
            t = frame[[f"t{i}" for i in range(k + 1)]].to_numpy()
            b = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), t)
            yield frame[keys].assign(**{f"b{i}": b[:, i] for i in range(k + 1)})

    return asked.mapInPandas(run, schema)


def huber_fit(df: DataFrame, keys: list[str], features: list[str], y: str, ridge: float = 0.0, turns: int = 12, c: float = 1.345, still: float = 1e-12) -> DataFrame:
    """Several features by iteratively reweighted least squares with Huber's weights; the scale is 1.4826 times the exact median of absolute residuals.

    It ends after `turns`, or once no coefficient of any key moves by more than `still` of its size. A turn is one pass of weighted sums and one exact median (two passes that count);
    sums, medians and coefficients are written, so that rows meet tables of known size and aren't shuffled, and a lost executor costs one turn.
    """
    rows = materialize(complete(df, [*features, y]).select(*keys, *features, y))
    fits, scales, weighted = None, None, rows.withColumn("_w", F.lit(1.0))
    for _ in range(turns):
        sums = weighted.groupBy(*keys).agg(*product_sums(features, y, F.col("_w")))
        held = materialize(sums)  # both the systems and their rows are read from it: one pass
        last, fits = fits, materialize(solve(held, keys, len(features), ridge).join(held.select(*keys, F.col("n").cast("long").alias("n")), keys))
        discard(held)
        if scales is not None:
            discard(scales)
        if last is not None:
            moved = _largest_move(last, fits, keys, len(features))
            discard(last)
            if moved <= still:
                break
        left = rows.join(fits, keys).withColumn("_r", F.abs(F.col(y) - predicted(features))).select(*rows.columns, "_r")
        scales = size_medians(left, keys, "_r", "_s")
        weighted = left.join(scales, keys).withColumn("_w", F.least(F.lit(1.0), c * F.greatest(1.4826 * F.col("_s"), F.lit(1e-9)) / F.greatest("_r", F.lit(1e-12)))).drop("_r", "_s")
    return fits


def _largest_move(before: DataFrame, after: DataFrame, keys: list[str], k: int) -> float:
    """The largest change of any coefficient between two turns, relative to one more than its size."""
    old = before.select(*keys, *(F.col(f"b{i}").alias(f"_b{i}") for i in range(k + 1)))
    moves = [F.abs(F.col(f"b{i}") - F.col(f"_b{i}")) / (1 + F.abs(f"b{i}")) for i in range(k + 1)]
    return after.join(old, keys).agg(F.max(F.greatest(*moves, F.lit(0.0))).alias("m")).first().m or 0.0


def predicted(features: list[str]) -> Column:
    out = F.col("b0")
    for i, f in enumerate(features, 1):
        out = out + F.col(f"b{i}") * F.col(f)
    return out


def weighted_fit(df: DataFrame, keys: list[str], features: list[str], y: str, weight: str | None = None, ridge: float = 0.0) -> DataFrame:
    """Weighted least squares of each key, with an unpenalised constant; weights are scaled to mean one, so that the penalty means the same."""
    held = complete(df, [*features, y, *([weight] if weight else [])])
    k = len(features)
    if weight is None:
        sums = held.groupBy(*keys).agg(*product_sums(features, y))
    else:
        raw = held.where(f"{weight} > 0").groupBy(*keys).agg(*product_sums(features, y, F.col(weight)))
        sums = raw.select(*keys, "n", *((F.col(c) * F.col("n") / F.col("s0_0")).alias(c) for c in sum_names(k)[1:]))
    return solve(sums, keys, k, ridge).join(sums.select(*keys, F.col("n").cast("long").alias("n")), keys)


def walk_forward(df: DataFrame, group: str, day: str, features: list[str], y: str, least_rows: int, least_groups: int, ridge: float = 0.0) -> DataFrame:
    """Each row's prediction from all rows of strictly earlier days and other groups, in which every group weighs the same.

    A group's weight is one over its earlier rows, so what a test needs is the sum over groups of their means of products
    before that day, less its own group's. Each (group, day) changes its group's means by a difference; running sums of the
    differences over the distinct days give that sum, without a join of rows to their training rows.
    """
    held, k = complete(df, [*features, y]), len(features)
    cells = held.groupBy(group, day).agg(*product_sums(features, y))
    past = Window.partitionBy(group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    names = sum_names(k)
    before = cells.select("*", *(F.coalesce(F.sum(c).over(past), F.lit(0.0)).alias(f"p_{c}") for c in names))
    mean_before = {c: F.when(F.col("p_n") > 0, F.col(f"p_{c}") / F.col("p_n")).otherwise(0.0) for c in names[1:]}
    mean_after = {c: (F.col(f"p_{c}") + F.col(c)) / (F.col("p_n") + F.col("n")) for c in names[1:]}
    changes = before.groupBy(day).agg(
        F.sum("n").alias("c_n"), F.sum((F.col("p_n") == 0).cast("double")).alias("c_groups"), *(F.sum(mean_after[c] - mean_before[c]).alias(f"c_{c}") for c in names[1:])
    )
    earlier = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    running = changes.select(day, *(F.sum(c).over(earlier).alias(c) for c in changes.columns if c != day))
    own = (F.col("p_n") > 0).cast("double")
    train = before.join(running, day).select(
        group,
        day,
        (F.col("c_n") - F.col("p_n")).alias("n"),
        (F.col("c_groups") - own).alias("train_groups"),
        *((F.col(f"c_{c}") - mean_before[c]).alias(c) for c in names[1:]),
    )
    gated = train.where(f"n >= {least_rows} and train_groups >= {least_groups}").withColumn("_ridge_share", ridge * F.col("train_groups") / F.col("n"))
    fits = solve(gated, [group, day], k, "_ridge_share")
    return held.join(fits, [group, day]).withColumn("predicted", predicted(features)).withColumn("error", F.col("predicted") - F.col(y))


def leave_one_row_out(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Each row's prediction from the line through its key's other rows: totals less the row's own part."""
    held = complete(df, [x, y])
    sums = held.groupBy(*keys).agg(*product_sums([x], y))
    a, b, one = F.col(x), F.col(y), F.lit(1.0)
    n, sx, sxx, sy, sxy = (F.col(c) - o for c, o in (("n", one), ("s0_1", a), ("s1_1", a * a), ("t0", b), ("t1", a * b)))
    slope = F.when((F.col("n") > 2) & (n * sxx - sx * sx > 1e-9), (n * sxy - sx * sy) / (n * sxx - sx * sx))
    return held.join(sums, keys).withColumn("slope", slope).withColumn("predicted", (sy - slope * sx) / n + slope * a).drop(*sum_names(1))


def two_stage(df: DataFrame, keys: list[str], x: str, y: str, date: str) -> DataFrame:
    """A line of y on x, and a line of what it leaves on the date; both from one pass of sums."""
    s = complete(df, [x, y, date]).groupBy(*keys).agg(*product_sums([x, date], y))
    n, x_, z, xx, xz, zz, y_, xy, zy = (F.col(c) for c in ("n", "s0_1", "s0_2", "s1_1", "s1_2", "s2_2", "t0", "t1", "t2"))
    slope = (n * xy - x_ * y_) / (n * xx - x_ * x_)
    fits = s.where(n * xx - x_ * x_ > 1e-9).withColumn("slope", slope).withColumn("intercept", (y_ - F.col("slope") * x_) / n)
    left = zy - F.col("slope") * xz - F.col("intercept") * z  # the products of residuals with the date; residuals add up to nothing
    drift = F.when(n * zz - z * z > 1e-9, n * left / (n * zz - z * z))
    return fits.withColumn("date_slope", drift).select(*keys, n.cast("long").alias("n"), "slope", "intercept", "date_slope", (-F.col("date_slope") * z / n).alias("date_intercept"))


def residual_ridge(df: DataFrame, keys: list[str], part: str, feature: str, residual: str, penalty: float) -> DataFrame:
    """A second stage on a baseline's residuals: each part's coefficient, penalised the more the fewer rows cover it, and shrunk by n / (n + 2)."""
    z, r = F.col(feature), F.col(residual)
    sums = complete(df, [feature, residual]).groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"), F.sum(z * z).alias("_zz"), F.sum(z * r).alias("_zr"))
    scaled = sums.withColumn("penalty", penalty * F.max("n").over(Window.partitionBy(*keys)) / F.col("n"))
    return scaled.select(*keys, part, "n", "penalty", (F.col("_zr") / (F.col("_zz") + F.col("penalty")) * F.col("n") / (F.col("n") + 2)).alias("coefficient"))


def feature_bases(df: DataFrame, train: Column, x: str, z: str) -> DataFrame:
    """Square, interaction and hinges at the quartiles of x, which are those of the training rows."""
    knots = quantiles(df.where(train), [], x, {"_a": 0.25, "_b": 0.5, "_c": 0.75}).select(F.array("_a", "_b", "_c").alias("_k"))
    hinges = {f"hinge_{i + 1}": F.greatest(F.lit(0.0), F.col(x) - F.col("_k")[i]) for i in range(3)}
    return df.crossJoin(knots).withColumns({"square": F.col(x) * F.col(x), "interaction": F.col(x) * F.col(z), **hinges}).drop("_k")  # knots are one row


def standardised(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """(value - median) / scaled absolute deviation, clipped; a missing value counts as the centre."""
    scales = robust_scale(df.where(f"{value} is not null"), keys, value)
    z = (F.col(value) - F.col("centre")) / F.col("scale")
    return df.join(scales, keys, "left").withColumn("z", F.coalesce(F.greatest(F.lit(-limit), F.least(F.lit(limit), z)), F.lit(0.0))).drop("centre", "scale")


def near_best(df: DataFrame, keys: list[str], loss: str, tolerance: float, prefer: Column) -> DataFrame:
    """Of each key, the preferred one among all within a tolerance of the least loss."""
    best = Window.partitionBy(*keys)
    near = df.withColumn("_best", F.min(loss).over(best)).where(F.col(loss) <= F.col("_best") + tolerance)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(prefer, F.col(loss)))).where("_r = 1").drop("_r", "_best")


def choose_penalty(df: DataFrame, group: str, x: str, y: str, penalties: list[float], tolerance: float) -> DataFrame:
    """The losses of penalties in folds that leave a group out (mean over groups of their mean absolute errors), and the one chosen.

    The strongest penalty within the tolerance of the best wins. Fits come from totals less the group's sums.
    """
    held = complete(df, [x, y])
    sums = held.groupBy(group).agg(*product_sums([x], y))
    names = sum_names(1)
    total = sums.agg(*(F.sum(c).alias(f"a_{c}") for c in names))
    train = sums.crossJoin(total).select(group, *((F.col(f"a_{c}") - F.col(c)).alias(c) for c in names))  # the total is one row
    graded = train.select("*", F.explode(F.array(*map(F.lit, penalties))).alias("penalty"))
    fits = solve(graded, [group, "penalty"], 1, "penalty")
    folds = held.join(fits, group).groupBy(group, "penalty").agg(F.avg(F.abs(predicted([x]) - F.col(y))).alias("_e"))
    losses = folds.groupBy("penalty").agg(F.avg("_e").alias("loss"))
    chosen = near_best(losses.withColumn("_all", F.lit(1)), ["_all"], "loss", tolerance, F.desc("penalty")).select("penalty", F.lit(True).alias("chosen"))
    return losses.join(chosen, "penalty", "left").fillna(False, ["chosen"])


def profile_exponent(df: DataFrame, x: str, y: str, steps: int) -> DataFrame:
    """y on x to a power from 0 to 1: of all powers with a rising line, the one with the least squared error (ties to the smaller)."""
    powers = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_k")
    raised = complete(df, [x, y]).where(f"{x} > 0").select(F.col(y).alias("_y"), F.col(x).alias("_x0"), powers).withColumn("_x", F.pow("_x0", F.col("_k") / steps))
    fits = raised.groupBy("_k").agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), (F.regr_syy("_y", "_x") - F.pow(F.regr_sxy("_y", "_x"), F.lit(2.0)) / F.regr_sxx("_y", "_x")).alias("sse"))
    best = fits.where("slope > 0").agg(F.min(F.struct("sse", "_k", "slope", "intercept")).alias("_b"))
    return best.where("_b is not null").select((F.col("_b._k") / steps).alias("exponent"), F.col("_b.slope").alias("slope"), F.col("_b.intercept").alias("intercept"), F.col("_b.sse").alias("sse"))


def inverse_prediction(target: Column, slope: Column, intercept: Column) -> Column:
    """The x at which a line reaches the target; null for a flat line."""
    return F.when(F.abs(slope) > 1e-12, (target - intercept) / slope)


def coefficient_bootstrap(df: DataFrame, cluster: str, x: str, y: str, wanted: int, tries: int, seed: int) -> DataFrame:
    """The slope of lines through resampled clusters; draws without a rising line are rejected, and the first `wanted` others are kept.

    Clusters are summed first and numbered by name; a draw adds up as many clusters as there are.
    """
    sums = complete(df, [x, y]).groupBy(cluster).agg(*product_sums([x], y))
    placed = numbered(sums, [], cluster)
    n, sx, sxx, sy, sxy = (F.sum(c) for c in ("n", "s0_1", "s1_1", "t0", "t1"))
    slopes = drawn(placed, tries, seed).join(placed, "_k").groupBy("draw").agg(F.when(n * sxx - sx * sx > 1e-9, (n * sxy - sx * sy) / (n * sxx - sx * sx)).alias("slope"))
    kept = slopes.where("slope > 0").orderBy("draw").limit(wanted)
    return kept.agg(F.count(F.lit(1)).alias("accepted"), (F.max("draw") + 1).alias("tried"), F.percentile("slope", F.lit(0.05)).alias("low"), F.percentile("slope", F.lit(0.5)).alias("middle"), F.percentile("slope", F.lit(0.95)).alias("high"))
