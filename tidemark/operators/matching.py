"""Joins with cardinality rules, entity matching and snapshot comparison."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.likeness import most_similar
from tidemark.operators.pairing import best_similar
from tidemark.session import ship, shuffle_partitions


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that fails if a key of the right side isn't unique; the check rides on the aggregate, not on an extra job."""
    rest = [c for c in right.columns if c not in keys]
    guarded = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in rest))
    checked = guarded.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a key is not unique"))).otherwise(True).cast("boolean")).drop("_n")
    return left.join(checked, keys, how)


def join_unique_keys(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, fields: list[str]) -> DataFrame:
    """Fields of the right row whose key matches, only where exactly one row has that key; with the number of candidates."""
    singles = right.groupBy(right_key.alias("_k")).agg(F.count(F.lit(1)).alias("candidates"), *(F.min(f).alias(f) for f in fields))
    joined = left.withColumn("_k", left_key).join(singles, "_k", "left").drop("_k")
    out = joined.withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    for f in fields:
        out = out.withColumn(f, F.when(F.col("candidates") == 1, F.col(f)))
    return out.withColumn("status", F.when(F.col("candidates") == 1, "matched").when(F.col("candidates") > 1, "ambiguous").otherwise("unmatched"))


def least_disagreement(left: DataFrame, right: DataFrame, keys: list[str], compared: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """Of the candidates with equal keys the one that differs in fewest fields; a tie leaves the row unmatched.

    No candidate pairs are made: for each subset of the fields the right side is counted by keys and those fields, and a left row
    looks up the count. Of the largest subsets with a candidate each candidate agrees on just one, so their counts add up.
    """
    subsets = [s for size in range(len(compared), -1, -1) for s in combinations(range(len(compared)), size)]
    out = left
    for at, subset in enumerate(subsets):
        names = [compared[i][1] for i in subset]
        seen = right.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias(f"_n{at}"), F.min(right_id).alias(f"_r{at}"))
        seen = seen.withColumnsRenamed({c: f"_{at}_{c}" for c in (*keys, *names)})
        same = [F.col(k) == F.col(f"_{at}_{k}") for k in keys] + [F.col(compared[i][0]).eqNullSafe(F.col(f"_{at}_{compared[i][1]}")) for i in subset]
        out = out.join(seen, reduce(lambda a, b: a & b, same), "left").drop(*(f"_{at}_{c}" for c in (*keys, *names)))
    best, tied, found = F.lit(None).cast("int"), F.lit(0), F.lit(None)
    for size in range(len(compared) + 1):
        level = [at for at, s in enumerate(subsets) if len(s) == size]
        total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"_n{at}"), F.lit(0)) for at in level))
        best, tied = F.when(total > 0, len(compared) - size).otherwise(best), F.when(total > 0, total).otherwise(tied)
        found = F.when(total > 0, F.coalesce(*(F.col(f"_r{at}") for at in level))).otherwise(found)
    return out.select(left_id, F.when(tied == 1, found).alias(right_id), best.alias("disagreement"), tied.cast("long").alias("tied"))


def cascade(left: DataFrame, rules: list[tuple[str, DataFrame]], key: str, target: str) -> DataFrame:
    """The first rule that has a row for the key wins, and names the method. Each rule is a table of (key, target), unique by key."""
    out, names, hits = left, [], []
    for at, (name, table) in enumerate(rules):
        out = out.join(table.select(key, F.col(target).alias(f"_t{at}")), key, "left")
        names.append(F.when(F.col(f"_t{at}").isNotNull(), name))
        hits.append(F.col(f"_t{at}"))
    done = out.withColumn(target, F.coalesce(*hits)).withColumn("method", F.coalesce(*names, F.lit("unmatched")))
    return done.drop(*(f"_t{at}" for at in range(len(rules))))


def range_match(left: DataFrame, right: DataFrame, block: list[str], near: Column, score: Column, order: list[Column], left_id: str) -> DataFrame:
    """Within equal block keys the best-scored candidate inside the ranges; block keys should bucket one of the ranges too."""
    candidates = left.join(right, block).where(near).withColumn("score", score)
    rank = Window.partitionBy(left_id).orderBy(*order)
    return candidates.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def apply_overrides(base: DataFrame, overrides: DataFrame, key: str, field: str) -> DataFrame:
    """Replace a field where the override's expected value still holds; an override that no longer fits fails the job."""
    small = overrides.select(key, F.col("expected").alias("_e"), F.col("replacement").alias("_x"), F.lit(True).alias("_o"))
    joined = base.join(small, key, "left")
    fits = F.col("_o").isNotNull() & F.col(field).eqNullSafe(F.col("_e"))
    stale = F.col("_o").isNotNull() & ~F.col(field).eqNullSafe(F.col("_e"))
    value = F.when(fits, F.col("_x")).when(stale, F.raise_error(F.lit("an override expects another value"))).otherwise(F.col(field))
    return joined.withColumn("overridden", fits).withColumn(field, value).drop("_e", "_x", "_o")


def active_rows(ledger: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    named = ledger.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return ledger.join(named, key, "left_anti")


def with_priority(df: DataFrame, key: list[str], source: str, ranking: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first source in the ranking, then the order given."""
    place = F.array_position(F.array(*map(F.lit, ranking)), F.col(source))
    rank = Window.partitionBy(*key).orderBy(place, *order)
    return df.where(place > 0).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that were added, removed or changed, with the names of the fields that changed."""
    a = before.select(key, F.struct(*fields).alias("_a"))
    b = after.select(key, F.struct(*fields).alias("_b"))
    joined = a.join(b, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), f) for f in fields)))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    out = joined.select(key, kind.alias("change"), F.when(kind == "changed", F.concat_ws("|", changed)).otherwise("").alias("fields"))
    return out.where("change <> 'changed' or fields <> ''")


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each field of a key in both snapshots that changed, with its value before and after as text."""
    a = before.select(key, *(F.col(f).cast("string").alias(f"_a_{f}") for f in fields))
    b = after.select(key, *(F.col(f).cast("string").alias(f"_b_{f}") for f in fields))
    entry = lambda f: F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").alias("before"), F.col(f"_b_{f}").alias("after")))
    return a.join(b, key).select(key, F.explode(F.array_compact(F.array(*map(entry, fields)))).alias("_c")).select(key, "_c.*")


def audited_match(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, block: str, manual: DataFrame, reviewed_none: DataFrame, least: float | None = None
) -> DataFrame:
    """Each left row's match with the rule that found it and how far to trust it.

    In order: a manual pair; the only right row of its name; several of its name (ambiguous, no match); reviewed as having none; if
    `least` is given, the only right row of the one most similar name (ambiguous if several are as good); the only right row of its
    block; else unmatched. Candidates are counted, never listed; similar names meet on rare q-grams (:mod:`pairing`).
    """
    one = lambda column, n: right.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(f"_n{n}"), F.min(right_id).alias(f"_r{n}"))
    joined = left.join(manual.select(left_id, F.col(right_id).alias("_m")), left_id, "left").join(one(name, 1), name, "left")
    joined = joined.join(reviewed_none.select(left_id, F.lit(True).alias("_none")).distinct(), left_id, "left").join(one(block, 2), block, "left")
    if least is None:
        joined = joined.withColumn("_n3", F.lit(0)).withColumn("_r3", F.lit(None).cast(right.schema[right_id].dataType))
    else:
        unknown = left.join(right, name, "left_anti").select(name)
        near = best_similar(unknown, right.select(name), least).select(F.col("left").alias(name), F.col("match").alias("_near"), "as_good")
        held = one(name, 3).withColumnRenamed(name, "_near")
        joined = joined.join(near.join(held, "_near").withColumn("_n3", F.greatest("_n3", "as_good")).drop("_near", "as_good"), name, "left")
    rules = [
        (F.col("_m").isNotNull(), "manual", F.col("_m"), 1.0),
        (F.col("_n1") == 1, "exact name", F.col("_r1"), 0.95),
        (F.col("_n1") > 1, "ambiguous name", None, 0.0),
        (F.col("_none"), "reviewed, none", None, 1.0),
        (F.col("_n3") == 1, "similar name", F.col("_r3"), 0.8),
        (F.col("_n3") > 1, "ambiguous similar name", None, 0.0),
        (F.col("_n2") == 1, "only one in block", F.col("_r2"), 0.6),
    ]
    pick = lambda i, last: reduce(lambda out, r: F.when(F.coalesce(r[0], F.lit(False)), r[i] if r[i] is not None else F.lit(None)).otherwise(out), reversed(rules), last)
    return joined.select(left_id, pick(2, F.lit(None)).alias(right_id), pick(1, F.lit("unmatched")).alias("method"), pick(3, F.lit(0.0)).alias("confidence"))


def _ratio_sides(left: DataFrame, right: DataFrame, right_id: str, size: str, name: str, ratio: float, cells: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (size, name) of both sides, right ones with the smallest id of their rows, by bucket (`_b`) of the size.

    Rows that agree on both are one candidate, however many there are. Sizes are cut into `cells` buckets for each step of the ratio on
    the log scale; a right one is offered to all buckets that can hold a partner. The step is a little wider than the ratio, so that
    rounding loses none. Sizes must be positive and finite.
    """
    bucket = lambda c: F.floor(F.log(c) * cells / F.log(F.lit(ratio * (1 + 1e-9))))
    held = lambda df: df.where(f"{size} > 0 and {size} < double('Infinity') and {name} is not null")
    a = held(left).select(F.col(size).alias("_ls"), F.col(name).alias("_ln")).distinct().withColumn("_b", bucket("_ls"))
    b = held(right).groupBy(F.col(size).alias("_rs"), F.col(name).alias("_rn")).agg(F.min(F.struct(right_id)).alias("_r"))
    return a, b.select("*", F.explode(F.sequence(bucket("_rs") - cells, bucket("_rs") + cells)).alias("_b"))


def ratio_candidates(left: DataFrame, right: DataFrame, right_id: str, size: str, name: str, ratio: float, cells: int = 4) -> DataFrame:
    """Pairs of distinct (size, name) whose sizes lie within a ratio (`gap`), with the smallest id of the right one's rows: an equi-join."""
    a, b = _ratio_sides(left, right, right_id, size, name, ratio, cells)
    gap = F.greatest(F.col("_ls") / F.col("_rs"), F.col("_rs") / F.col("_ls"))
    return a.join(b, "_b").drop("_b").withColumn("gap", gap).where(F.col("gap") <= ratio)


def ratio_match(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: str, name: str, ratio: float, least_similarity: float, cells: int = 2, block: int = 8192
) -> DataFrame:
    """The most similar right name (ties to the nearer size, then the smaller id) whose size is within a ratio, if similar enough.

    Similarity is one less the edit distance over the longer length. Distinct sizes and names meet by bucket of the size, each distinct
    left one gets its best, and rows get theirs by size and name. A bucket is dealt into blocks of some `block` rows of each side
    (fewer, if names have over 32 letters), counted before, and a task holds one block (:mod:`likeness`): pairs are neither listed nor
    sorted, and no bucket is too large. The comparisons are as many as distinct partners within the ratio: time grows with the square
    of distinct sizes and names, what is shuffled with the rows and, where buckets hold more than a block, with the blocks of the other
    side.
    """
    spark = left.sparkSession
    ship(spark)
    a, b = _ratio_sides(left, right, right_id, size, name, ratio, cells)
    count = lambda df, name, n: df.groupBy("_b").agg(F.ceil(F.sum(F.greatest(F.length(name) / 32, F.lit(1.0))) / block).alias(n))
    blocks = count(a, "_ln", "_m").join(count(b, "_rn", "_n"), "_b")
    deal = lambda df, own, n, key, other, m: df.join(blocks, "_b").select(
        "*", F.pmod(F.xxhash64(*key), n).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)).alias(other)
    )
    cell = ["_b", "_i", "_j"]
    dealt = lambda df: df.repartition(shuffle_partitions(spark), *cell).groupBy(*cell)
    rows = dealt(deal(a, "_i", "_m", ["_ls", "_ln"], "_j", "_n").select(*cell, "_ls", "_ln"))
    partners = dealt(deal(b, "_j", "_n", ["_rs", "_rn"], "_i", "_m").select(*cell, "_rs", "_rn", "_r"))
    schema = T.StructType([a.schema["_ls"], a.schema["_ln"], T.StructField("s", T.DoubleType()), T.StructField("g", T.DoubleType()), T.StructField("r", right.schema[right_id].dataType)])
    found = rows.cogroup(partners).applyInArrow(most_similar(ratio, least_similarity, schema), schema)
    tops = found.groupBy("_ls", "_ln").agg(F.min(F.struct("s", "g", "r")).alias("_x"))
    met = left.select(left_id, F.col(size).alias("_ls"), F.col(name).alias("_ln")).join(tops, ["_ls", "_ln"])
    best = met.groupBy(left_id).agg(F.min("_x").alias("_x"))
    return best.select(left_id, F.col("_x.r").alias(right_id), (-F.col("_x.s")).alias("similarity"))


def multiset_difference(left: DataFrame, right: DataFrame, signature: list[str]) -> DataFrame:
    """Signatures whose counts differ between two tables; each side is counted before they meet."""
    a = left.groupBy(*signature).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(*signature).agg(F.count(F.lit(1)).alias("right_rows"))
    return a.join(b, signature, "full").fillna(0, ["left_rows", "right_rows"]).where("left_rows <> right_rows")


def skyline(df: DataFrame, low: str, high: str, slices: int = 64) -> DataFrame:
    """Rows that no other dominates (low as small and high as large, one of them strictly), by running maxima, not pairs.

    The best of each low value is found by a partial aggregate. These are cut into ranges of low; a window runs inside each
    range, and a second one over the few ranges tells each the best of those before it.
    """
    best = df.groupBy(low).agg(F.max(high).alias(high))
    edges = best.agg(F.percentile_approx(low, [i / slices for i in range(1, slices)]).alias("_e"))
    cut = best.crossJoin(F.broadcast(edges)).withColumn("_s", F.size(F.filter("_e", lambda e: e < F.col(low)))).drop("_e")
    tops = cut.groupBy("_s").agg(F.max(high).alias("_m"))
    past = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    limits = tops.withColumn("_p", F.max("_m").over(past)).select("_s", "_p")
    inside = Window.partitionBy("_s").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    marked = cut.withColumn("_b", F.max(high).over(inside)).join(F.broadcast(limits), "_s")
    front = marked.where(f"({high} > _b or _b is null) and ({high} > _p or _p is null)").select(low, high)
    return df.join(front, [low, high], "left_semi")


def missing_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has."""
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti")


def union_with_precedence(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first table, and the rows of the second whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def alias_lookup(df: DataFrame, aliases: str, table: DataFrame, alias: str, value: str, keys: list[str], separator: str = "|") -> DataFrame:
    """Split a delimited column, look each part up, and put back how many were found and the smallest value."""
    parts = df.select(*keys, F.explode(F.split(aliases, "\\" + separator)).alias("_a")).select(*keys, F.trim("_a").alias(alias)).where(f"{alias} <> ''")
    return parts.join(table.select(alias, value), alias, "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("aliases"), F.count(value).alias("found"), F.min(value).alias(value))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Empty if two tables hold the same rows as often; otherwise what each has beyond the other."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def all_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(and_, (F.col(c).isNotNull() for c in columns)))


def any_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(or_, (F.col(c).isNotNull() for c in columns)))
