"""Filters, projections and expectations over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What one of a unit is in the unit kept.
UNITS = {"usd_per_token": 1e6, "usd_per_mtoken": 1.0, "ms": 1e-3, "s": 1.0, "parameters": 1e-9, "billions": 1.0}


def eligible(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows on which every condition holds; a null condition doesn't."""
    return df.where(reduce(lambda a, b: a & b, conditions))


def by_specification(df: DataFrame, specifications: dict[str, Column], name: str = "specification") -> DataFrame:
    """Each row once for each specification that admits it; one pass, however many there are."""
    admitted = F.array_compact(F.array(*(F.when(c, n) for n, c in specifications.items())))
    return df.withColumn(name, F.explode(admitted))


def nested(json: Column, *path: str) -> Column:
    """The text at a path inside JSON text; null where any step is missing or the text is no JSON."""
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path))


def rescaled(x: Column, unit: str) -> Column:
    """Prices per million tokens, times in seconds, sizes in thousand millions."""
    return x * UNITS[unit]


def with_record(df: DataFrame, name: str = "source_record") -> DataFrame:
    """The whole row as JSON beside its columns; null fields stay in it."""
    return df.withColumn(name, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))


def onto_schema(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Exactly the given fields in their order and type; those that are missing are null, and nothing else passes."""
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields.items()))


def date_conflict(canonical: Column, source: Column, days: int) -> tuple[Column, Column]:
    """Whether two dates lie more than so many days apart, and a sentence that says so."""
    gap = F.datediff(source, canonical)
    flag = F.coalesce(F.abs(gap) > days, F.lit(False))
    return flag, F.when(flag, F.format_string("source date %s is %s days from %s", source.cast("string"), gap.cast("string"), canonical.cast("string")))


def range_violations(df: DataFrame, keys: list[str], ranges: dict[str, tuple[Column | float, Column | float]]) -> DataFrame:
    """Rows with a value outside of its range, and the names of those columns; a null is no violation."""
    outside = F.array_compact(F.array(*(F.when(~F.col(c).between(low, high), c) for c, (low, high) in ranges.items())))
    return df.select(*keys, F.concat_ws("|", outside).alias("outside")).where("outside <> ''")


def least_override(overrides: Column, threshold: str, *fields: str) -> Column:
    """Of an array of structs the one with the smallest threshold, as a struct of threshold and fields; null if none has one."""
    held = F.filter(overrides, lambda o: o[threshold].isNotNull())
    return F.array_min(F.transform(held, lambda o: F.struct(o[threshold].alias(threshold), *(o[f].alias(f) for f in fields))))


def rollup_row(df: DataFrame, keys: list[str], value: str, order: list[str], label: str) -> DataFrame:
    """One row a key: largest value, the label of the first row in an order, and rows."""
    return df.groupBy(*keys).agg(F.max(value).alias("largest"), F.min(F.struct(*order, label)).alias("_f"), F.count(F.lit(1)).alias("rows")).select(*keys, "largest", F.col(f"_f.{label}").alias("first_label"), "rows")


def joined_values(x: Column, separator: str = "|") -> Column:
    """The sorted distinct values of a group as one text: an aggregate for groups of few values."""
    return F.concat_ws(separator, F.array_sort(F.collect_set(x)))


def json_series(moment: Column, value: Column) -> Column:
    """A JSON object from moments to values, in order: an aggregate for groups of few rows."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(moment.cast("string"), value)))))


def composite_medians(df: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """Medians of groups with at least so many members."""
    return df.where(f"{value} is not null").groupBy(*keys).agg(F.median(value).alias("composite"), F.count(F.lit(1)).alias("members")).where(f"members >= {least}")


def range_and_uplift(df: DataFrame, keys: list[str], treated: Column, value: str) -> DataFrame:
    """The range inside a group, and in groups with both classes the difference of their means."""
    of = lambda c: F.avg(F.when(c, F.col(value)))
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("range"), (of(treated) - of(~treated)).alias("uplift"))


def line_digest(x: Column) -> Column:
    """The SHA-256 of the sorted distinct values, a line each. Such a digest needs a group's values in one place: for groups of few."""
    return F.sha2(joined_values(x, "\n"), 256)


def leave_one_out_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row with the mean of its group's other rows; null where there are none."""
    held = df.where(f"{value} is not null")
    sums = held.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return held.join(sums, keys).withColumn("others_mean", F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1))).drop("_s", "_n")


def collapse_preferred(df: DataFrame, keys: list[str], preferred: Column, value: str) -> DataFrame:
    """One row a key: the mean over preferred rows, or over all where none is preferred."""
    own = F.avg(F.when(preferred, F.col(value)))
    return df.groupBy(*keys).agg(F.coalesce(own, F.avg(value)).alias(value), F.count_if(preferred).alias("preferred_rows"), F.count(F.lit(1)).alias("rows"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order that leaves no ties, by a partial aggregate."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_l")).select(*keys, "_l.*").select(df.columns)


def equal_group_weights(df: DataFrame, group: str, halved: Column) -> DataFrame:
    """One over the rows of the group, halved for some rows, scaled to a mean of one over all rows."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    raw = df.join(sizes, group).withColumn("weight", F.when(halved, 0.5).otherwise(1.0) / F.col("_n")).drop("_n")
    return raw.crossJoin(raw.agg(F.avg("weight").alias("_m"))).withColumn("weight", F.col("weight") / F.col("_m")).drop("_m")  # the mean is one row


def best_row(df: DataFrame, keys: list[str], loss: str, ties: list[str]) -> DataFrame:
    """The row with the least loss of each key; equal losses go to the smallest of the tie columns."""
    rest = [c for c in df.columns if c not in (*keys, loss, *ties)]
    return df.groupBy(*keys).agg(F.min(F.struct(loss, *ties, *rest)).alias("_b")).select(*keys, "_b.*").select(df.columns)


def simplest_best(df: DataFrame, keys: list[str], loss: str, parts: str, digits: int = 3) -> DataFrame:
    """Losses that agree to so many digits are equal; of equals the row with fewest parts, then the first by name."""
    marked = df.withColumn("_l", F.round(loss, digits)).withColumn("_k", F.size(parts))
    rank = Window.partitionBy(*keys).orderBy("_l", "_k", F.concat_ws("|", parts))
    return marked.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "_l", "_k")


def listing(df: DataFrame, shown: Column, order: list[Column], columns: list[str]) -> DataFrame:
    """Rows to show, in a total order; range partitions sort, none gathers all."""
    return df.where(shown).orderBy(*order).select(*columns)


def disjoint_union(archived: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Both panels; a key in both fails the job when the rows are read. Columns follow in the order first seen."""
    both = archived.withColumn("_p", F.lit(1)).unionByName(current.withColumn("_p", F.lit(2)), allowMissingColumns=True)
    span = F.max("_p").over(Window.partitionBy(*keys)) - F.min("_p").over(Window.partitionBy(*keys))
    checked = both.withColumn("_s", span)
    return checked.where(F.when(F.col("_s") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("a key is in both panels")).cast("boolean"))).drop("_s", "_p")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't blank."""
    return df.select(F.trim(F.col(column).cast("string")).alias(column)).where(f"{column} <> ''").distinct()


def unique_key_report(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """What a load must satisfy, as one row: its rows, null keys, keys that occur more than once, and whether all is well."""
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    blank = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    out = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(blank, F.col("_n"))), F.lit(0)).alias("null_keys"), F.count_if(F.col("_n") > 1).alias("repeated_keys"))
    fits = (F.col("null_keys") == 0) & (F.col("repeated_keys") == 0) & (F.lit(True) if rows is None else F.col("rows") == rows)
    return out.withColumn("valid", fits)


def require_contract(df: DataFrame, header: list[str], keys: list[str], rows: int | None = None) -> DataFrame:
    """The rows, once they are known to have these columns in this order, no null or repeated key, and this number of rows; else ValueError.

    The check is one aggregate over the keys, run at once: a load that doesn't fit fails before anything is made of it.
    """
    if df.columns != header:
        raise ValueError(f"columns are {df.columns}, not {header}")
    found = unique_key_report(df, keys, rows).first()
    if not found.valid:
        wanted = "" if rows is None else f" of {rows}"
        raise ValueError(f"{found.rows}{wanted} rows, {found.null_keys} with a null in {keys}, {found.repeated_keys} repeated keys")
    return df


def renamed_shim(df: DataFrame, legacy: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns of old archives under their new names, with what was renamed, so that :func:`restored` can undo it."""
    applied = {old: new for old, new in legacy.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(applied), applied


def restored(df: DataFrame, applied: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in applied.items()})
