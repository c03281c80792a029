"""Window-style operators with explicit tie keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import cumulative_counts


def order_by(*keys: str) -> list[Column]:
    """Ascending keys, descending where they start with '-'."""
    return [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys]


def top_per_group(df: DataFrame, group: list[str], order: list[str], k: int = 1) -> DataFrame:
    """The first k rows of each group; Spark prunes to k in each task before the shuffle."""
    rank = Window.partitionBy(*group).orderBy(*order_by(*order))
    return df.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k).drop("_r")


def top_with_reason(df: DataFrame, group: list[str], order: list[str], score: str) -> DataFrame:
    """All rows, each with whether it was chosen and why not."""
    rank = Window.partitionBy(*group).orderBy(*order_by(*order))
    best = F.first(score).over(rank)
    return df.withColumn("position", F.row_number().over(rank)).withColumn(
        "reason", F.when(F.col("position") == 1, "chosen").when(F.col(score).eqNullSafe(best), "tie").otherwise("lower score")
    )


def latest_with_worst_tie(df: DataFrame, group: list[str], day: str, error: str, name: str) -> DataFrame:
    """The latest row of each group; of one day's rows the largest absolute error, then the smallest name."""
    rank = Window.partitionBy(*group).orderBy(F.desc(day), F.desc(F.abs(error)), F.asc(name))
    return df.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def running_records(df: DataFrame, group: list[str], day: str, value: str) -> DataFrame:
    """Days whose best value beats every earlier day's: best per day first, so a group's window holds days, not rows."""
    daily = df.groupBy(*group, day).agg(F.max(value).alias(value))
    before = F.max(value).over(Window.partitionBy(*group).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    return daily.withColumn("_b", before).where(f"_b is null or {value} > _b").drop("_b")


def chain_deltas(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The change against the row before and against the first row."""
    chain = Window.partitionBy(*group).orderBy(*order_by(*order))
    return df.withColumn("step", F.row_number().over(chain)).withColumn("from_previous", F.col(value) - F.lag(value).over(chain)).withColumn("from_first", F.col(value) - F.first(value).over(chain))


def change_points(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before (null counts as a value)."""
    chain = Window.partitionBy(*group).orderBy(*order_by(*order))
    return df.withColumn("_p", F.lag(value).over(chain)).withColumn("_n", F.row_number().over(chain)).where(f"_n = 1 or not ({value} <=> _p)").drop("_p", "_n")


def daily_forward_fill(df: DataFrame, group: list[str], moment: str, tie: str, value: str) -> DataFrame:
    """A row for each day from a group's first to its last change; a day's last change holds until the next one.

    The change's day is carried, not its value, so a change to null stops the fill.
    """
    day = F.to_date(moment)
    last = df.withColumn("day", day).groupBy(*group, "day").agg(F.max(F.struct(moment, tie, F.col(value).alias("value"))).alias("_c"))
    span = last.groupBy(*group).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    carried = F.max(F.when(F.col("_c").isNotNull(), F.col("day"))).over(Window.partitionBy(*group).orderBy("day"))
    marked = span.join(last, [*group, "day"], "left").withColumn("changed_on", carried)
    source = last.select(*group, F.col("day").alias("changed_on"), F.col("_c.value").alias("value"))
    return marked.select(*group, "day", "changed_on").join(source, [*group, "changed_on"]).select(*group, "day", "changed_on", "value")


def lookahead_means(daily: DataFrame, group: list[str], value: str, spans: list[int]) -> DataFrame:
    """Means over the first days of each group, only where the whole span was observed."""
    first = Window.partitionBy(*group)
    aged = daily.withColumn("_age", F.datediff("day", F.min("day").over(first)))
    inside = [F.when(F.count(F.when(F.col("_age") < n, 1)) == n, F.avg(F.when(F.col("_age") < n, F.col(value)))).alias(f"mean_{n}d") for n in spans]
    return aged.groupBy(*group).agg(F.count(F.lit(1)).alias("days"), *inside)


def first_seen(df: DataFrame, entity: list[str], moment: str, tie: str) -> DataFrame:
    """The earliest row of each entity, by a partial aggregate."""
    rest = [c for c in df.columns if c not in (*entity, moment, tie)]
    return df.groupBy(*entity).agg(F.min(F.struct(moment, tie, *rest)).alias("_f")).select(*entity, "_f.*")


def interval_of(events: DataFrame, snapshots: DataFrame, moment: str, stamp: str) -> DataFrame:
    """The snapshots around each event: the last one before it and the first one at or after it; both null after the last snapshot.

    Snapshots are distinct stamps, in their thousands at most: they travel as one sorted array, in which each event finds its place.
    """
    edges = snapshots.select(stamp).distinct().agg(F.array_sort(F.collect_list(stamp)).alias("_s"))
    before = F.size(F.filter("_s", lambda s: s < F.col(moment)))
    placed = events.crossJoin(edges).withColumn("_b", before)  # the array is one row
    seen = placed.withColumn("observed_snapshot", F.try_element_at("_s", F.col("_b") + 1))
    return seen.withColumn("previous_snapshot", F.when(F.col("observed_snapshot").isNotNull(), F.try_element_at("_s", F.nullif(F.col("_b"), F.lit(0))))).drop("_s", "_b")


def monotone_report(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Of each group: rows, steps down, and repeats of the value before."""
    chain = Window.partitionBy(*group).orderBy(*order_by(*order))
    before = df.withColumn("_p", F.lag(value).over(chain))
    return before.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value) < F.col("_p")).alias("steps_down"), F.count_if(F.col(value) == F.col("_p")).alias("repeats"))


def ecdf(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The share of the group's rows at or below each value."""
    counts = cumulative_counts(df, group, value)
    return counts.join(counts.groupBy(*group).agg(F.sum("rows").alias("_n")), group).select(*group, value, "rows", ((F.col("before") + F.col("rows")) / F.col("_n")).alias("share"))


def order_statistic(df: DataFrame, group: list[str], value: str, coverage: float) -> DataFrame:
    """The ceil((n + 1) * coverage)-th smallest value, null where there are too few rows to have one."""
    counts = cumulative_counts(df.where(F.col(value).isNotNull()), group, value)
    sizes = counts.groupBy(*group).agg(F.sum("rows").alias("n")).withColumn("rank", F.ceil((F.col("n") + 1) * F.lit(coverage)).cast("long"))
    holds = (F.col("before") < F.col("rank")) & (F.col("before") + F.col("rows") >= F.col("rank"))
    return counts.join(sizes, group).groupBy(*group, "n", "rank").agg(F.max(F.when(holds, F.col(value))).alias("order_statistic"))


def numbered(df: DataFrame, group: list[str], order: list[str], prefix: str) -> DataFrame:
    """Zero-padded ids in the order given inside each group."""
    return df.withColumn("id", F.concat(F.lit(prefix), F.lpad(F.row_number().over(Window.partitionBy(*group).orderBy(*order_by(*order))).cast("string"), 6, "0")))
