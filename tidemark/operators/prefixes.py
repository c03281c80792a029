"""Order statistics of everything before a day: ranks in, and medians of, sets that grow from day to day.

Rows are counted by (group, day, value) first, and a group's values are cut into slices at approximate quantiles. A grid of
days and slices, as many cells as there are days times slices, holds running sums over both: what lies in lower slices on earlier
days is read from it. What lies in the same slice is settled inside it, by one task that goes through the slice's days once. No
row meets another day's rows in a join, and a task holds a slice, not a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import materialize, ship

#: Counted rows of a slice, about, and bounds of the number of slices (the upper one bounds the grid and the edges of a group).
SLICE_ROWS = 100_000
FEWEST, MOST = 8, 4096


def _place(edges: Column, value: Column, slices: int) -> Column:
    """How many of the sorted edges are below a value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((slices - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < value, at + step).otherwise(at))


def _grid(cells: DataFrame, days: DataFrame, group: list[str], day: str) -> DataFrame:
    """For each day and slice of a group: rows on earlier days in the slice (upto), in lower slices (below), and in all (earlier)."""
    grid = days.join(cells.select(*group, "_s").distinct(), group).join(cells, [*group, day, "_s"], "left").fillna(0, ["n"])
    past = Window.partitionBy(*group, "_s").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group, day)
    upto = grid.withColumn("upto", F.coalesce(F.sum("n").over(past), F.lit(0)))
    below = F.coalesce(F.sum("upto").over(across.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return upto.select(*group, day, "_s", "upto", below.alias("below"), F.sum("upto").over(across).alias("earlier"))


def _walk(answer, group: list[str], schema: T.StructType):
    """A function over one slice's rows (day, value, n, and a question's wanted rank) that goes through its days once.

    `answer` takes the running counts of the slice's distinct values, as sums, and the questions of a day.
    """

    def run(part: pa.Table) -> pa.Table:
        day = part.column("_day").to_numpy()
        order = np.argsort(day, kind="stable")
        day, value, n, wanted = (part.column(c).to_numpy(zero_copy_only=False)[order] for c in ("_day", "_value", "n", "wanted"))
        asks = wanted >= 0
        distinct, code = np.unique(value[~asks], return_inverse=True)
        codes = np.zeros(len(day), np.int64)
        codes[~asks] = code
        held, out = np.zeros(len(distinct), np.int64), np.zeros(len(day), np.float64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(day)) + 1, [len(day)]])
        for first, last in zip(edges[:-1], edges[1:]):
            rows = np.arange(first, last)
            questions = rows[asks[first:last]]
            if len(questions):
                out[questions] = answer(distinct, np.concatenate([[0], np.cumsum(held)]), value[questions], wanted[questions])
            added = rows[~asks[first:last]]
            np.add.at(held, codes[added], n[added])
        kept = order[asks]
        columns = [part.column(c).take(pa.array(kept)) for c in [*group, "_s", "_day", "_value", "wanted"]]
        return pa.Table.from_arrays([*columns, pa.array(out[asks])], names=[*group, "_s", "_day", "_value", "wanted", "answer"]).cast(to_arrow_schema(schema))

    return run


def _settle(history: DataFrame, questions: DataFrame, group: list[str], answer) -> DataFrame:
    """Answers to questions (group, _s, _day, _value, wanted) from the history of their slice (group, _s, _day, _value, n)."""
    ship(history.sparkSession)
    both = history.withColumn("wanted", F.lit(-1).cast("long")).unionByName(questions.withColumn("n", F.lit(0).cast("long")))
    schema = T.StructType([*(history.schema[c] for c in group), *(T.StructField(c, t) for c, t in (("_s", T.IntegerType()), ("_day", T.LongType()), ("_value", T.DoubleType()), ("wanted", T.LongType()), ("answer", T.DoubleType())))])
    return both.groupBy(*group, "_s").applyInArrow(_walk(answer, group, schema), schema)


def _rank_of(distinct: np.ndarray, sums: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return sums[np.searchsorted(distinct, values, side="right")]


def _value_at(distinct: np.ndarray, sums: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return distinct[np.searchsorted(sums, wanted, side="right") - 1]


def _prepared(history: DataFrame, group: list[str], day: str, value: str, slices: int | None) -> DataFrame:
    """Counted history (group, _day, _value, n) with its slice (_s)."""
    number = F.unix_date(F.to_date(day)).cast("long")
    named = history.where(F.col(value).isNotNull() & F.col(day).isNotNull())
    counts = materialize(named.select(*group, number.alias("_day"), F.col(value).cast("double").alias("_value")).groupBy(*group, "_day", "_value").agg(F.count(F.lit(1)).alias("n")))
    slices = slices or max(FEWEST, min(MOST, -(-counts.count() // SLICE_ROWS)))
    edges = counts.groupBy(*group).agg(F.percentile_approx("_value", [k / slices for k in range(1, slices)], F.lit(10 * slices)).alias("_edges"))
    return counts.join(edges, group).withColumn("_s", _place(F.col("_edges"), F.col("_value"), slices)).drop("_edges")


def prefix_ranks(df: DataFrame, group: list[str], day: str, value: str, slices: int | None = None) -> DataFrame:
    """Of each (group, day, value) its rows, the group's rows on strictly earlier days, and the share of these at or below the value.

    Days without an earlier one are left out; so are rows without a day or a value. Ties are rows of one value and count as at or below.
    """
    counts = _prepared(df, group, day, value, slices)
    cells = counts.groupBy(*group, "_s", "_day").agg(F.sum("n").alias("n"))
    grid = _grid(cells, counts.select(*group, "_day").distinct(), group, "_day")
    asked = counts.select(*group, "_s", "_day", "_value", F.lit(0).cast("long").alias("wanted"))
    inside = _settle(counts, asked, group, _rank_of).select(*group, "_s", "_day", "_value", "answer")
    met = counts.join(inside, [*group, "_s", "_day", "_value"]).join(grid, [*group, "_day", "_s"]).where("earlier > 0")
    kind = df.schema[value].dataType
    share = (F.col("below") + F.col("answer")) / F.col("earlier")
    return met.select(*group, F.date_from_unix_date(F.col("_day").cast("int")).alias(day), F.col("_value").cast(kind).alias(value), F.col("n").alias("rows"), "earlier", share.alias("share"))


def prefix_medians(history: DataFrame, asked: DataFrame, group: list[str], day: str, value: str, slices: int | None = None) -> DataFrame:
    """For each (group, day) of `asked` the median of the group's values on strictly earlier days (`median`) and their number (`n`).

    Days without earlier values are left out. The two middle ranks are found in the grid, and inside their slices.
    """
    counts = _prepared(history, group, day, value, slices)
    cells = counts.groupBy(*group, "_s", "_day").agg(F.sum("n").alias("n"))
    wanted_days = asked.select(*group, F.unix_date(F.to_date(day)).cast("long").alias("_day")).distinct()
    grid = _grid(cells, wanted_days.unionByName(counts.select(*group, "_day")).distinct(), group, "_day").join(wanted_days, [*group, "_day"])
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("earlier") - 1) / 2), F.floor(F.col("earlier") / 2))))
    found = grid.where("earlier > 0").select("*", middle.alias("rank")).where("below <= rank and rank < below + upto")
    questions = found.select(*group, "_s", "_day", F.lit(0.0).alias("_value"), (F.col("rank") - F.col("below")).cast("long").alias("wanted"))
    answers = _settle(counts, questions, group, _value_at).groupBy(*group, "_day").agg(F.avg("answer").alias("median"))
    sizes = grid.where("earlier > 0").groupBy(*group, "_day").agg(F.max("earlier").alias("n"))
    return answers.join(sizes, [*group, "_day"]).select(*group, F.date_from_unix_date(F.col("_day").cast("int")).alias(day), "median", "n")
