"""Frozen tables: a tree of digests over ranges of keys, and what changed since, found range by range.

A row's range is the beginning of its key's SHA-256, so ranges are of like size and don't move when rows come or go. A range's
digest is made of sums over its rows' digests, which any order and partitioning gives; the digest of a shorter range is that of its up to
16 parts. Two tables with equal roots are equal; otherwise only rows of ranges that differ are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8


def _text(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def row_digests(df: DataFrame, keys: list[str], depth: int = 2) -> DataFrame:
    """Keys, range (the first `depth` hexadecimal digits of the key's digest) and digest of each row: what a freeze keeps of its rows."""
    others = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, F.substring(F.sha2(_text(keys), 256), 1, depth).alias("range"), F.sha2(_text([*keys, *others]), 256).alias("digest"))


def digest_tree(rows: DataFrame, depth: int = 2) -> DataFrame:
    """(level, range, rows, digest) of all ranges of row digests, from the longest (level `depth`) to the whole table (level 0)."""
    words = [F.sum(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for i in range(WORDS)]
    summed = rows.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), *(w.alias(f"_{i}") for i, w in enumerate(words)))
    level = summed.select("range", "rows", F.sha2(F.concat_ws("|", "rows", *(f"_{i}" for i in range(WORDS))), 256).alias("digest"))
    out = level.select(F.lit(depth).alias("level"), "range", "rows", "digest")
    for size in range(depth - 1, -1, -1):
        parts = F.array_sort(F.collect_list(F.struct("range", "digest")))  # at most 16
        joined = F.concat_ws("|", F.transform(parts, lambda p: F.concat(p["range"], F.lit(":"), p["digest"])))
        level = level.groupBy(F.substring("range", 1, size).alias("range")).agg(F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("digest"))
        out = out.unionByName(level.select(F.lit(size).alias("level"), "range", "rows", "digest"))
    return out


def changed_ranges(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(level, range, frozen_rows, rows) of the ranges of two trees that differ; none if the tables are equal."""
    a = frozen.select("level", "range", F.col("rows").alias("frozen_rows"), F.col("digest").alias("_a"))
    b = now.select("level", "range", "rows", F.col("digest").alias("_b"))
    return a.join(b, ["level", "range"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b").fillna(0, ["frozen_rows", "rows"])


def verify_freeze(frozen: DataFrame, df: DataFrame, keys: list[str], depth: int = 2) -> DataFrame:
    """Keys, range and change ('added', 'removed' or 'changed') of the rows of `df` that aren't those whose digests were kept.

    `frozen` is what :func:`row_digests` gave. Rows of one key are one set: it is changed if its rows, each as often as it occurs, are others.
    """
    now = row_digests(df, keys, depth)
    ranges = changed_ranges(digest_tree(frozen, depth), digest_tree(now, depth)).where(F.col("level") == depth).select("range")
    kept, side = [*keys, "range"], F.col("_frozen")
    both = frozen.select(*kept, "digest", F.lit(True).alias("_frozen")).unionByName(now.select(*kept, "digest", F.lit(False).alias("_frozen")))
    rows = lambda mine: F.array_sort(F.collect_list(F.when(mine, F.col("digest"))))  # noqa: E731  rows of one key
    found = both.join(F.broadcast(ranges), "range", "left_semi").groupBy(*kept).agg(rows(side).alias("_a"), rows(~side).alias("_b"))  # at most 16 ** depth ranges
    change = F.when(F.size("_a") == 0, "added").when(F.size("_b") == 0, "removed").when(F.col("_a") != F.col("_b"), "changed")
    return found.select(*kept, change.alias("change")).where("change is not null")
