"""Sources and sinks over Spark's own readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A CSV file or folder (also compressed) with a header that must name the schema's columns; a row of another width fails.

    Quoted fields may hold quotes and, with `multi_line`, line ends; without it, files are split among tasks. A byte order
    mark is left out, and so are rows whose fields are all blank; blank fields are null.
    """
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, multiLine=multi_line, quote='"', escape='"', mode="FAILFAST", encoding="UTF-8", nullValue="")
    return raw.dropna("all")


def first_seen_union(*tables: DataFrame) -> DataFrame:
    """All rows of tables of unlike columns, with the columns in the order in which they are first seen; what a table lacks is null."""
    columns = list(dict.fromkeys(c for t in tables for c in t.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select(*(F.col(f"`{c}`") for c in columns))


def write_csv(df: DataFrame, path: str, columns: list[str] | None, key: list[str]) -> None:
    """CSV with columns (the table's own, if none are given) and row order fixed; null is an empty field.

    Files are cut by key ranges, not gathered in one.
    """
    df.select(*(columns or df.columns)).orderBy(*key).write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def write_gzip_csv(df: DataFrame, path: str, columns: list[str], key: list[str]) -> None:
    """Like :func:`write_csv`, compressed; the same rows give the same bytes, since rows, columns and files are in a fixed order.

    Spark's gzip codec stamps no time or name. Ranges are cut by the key, so the number of files follows the shuffle partitions.
    """
    df.select(*columns).orderBy(*key).write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="", compression="gzip")


def json_leaves(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each top-level field of JSON objects, with its text and, if it is one, its number. Bad JSON gives none."""
    fields = F.explode(F.from_json(text, "map<string,string>")).alias("leaf", "value_text")
    return df.select(*keys, fields).withColumn("value", F.col("value_text").try_cast("double"))


def embedded(df: DataFrame, keys: list[str], html: str) -> DataFrame:
    """What pages say of themselves: title, number of links, and whether they carry scripts."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return df.select(*keys, title.alias("title"), F.regexp_count(html, F.lit(r"(?i)<a\s")).cast("long").alias("links"), F.regexp_like(html, F.lit(r"(?i)<script")).alias("scripted"))


def row_digest(*columns: Column) -> Column:
    """The SHA-256 of the columns' texts joined by the unit separator; null counts as a null sign of its own."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)), 256)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes and SHA-256 of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Declared (path, sha256) pairs against found ones: 'ok', 'changed' or 'missing'."""
    held = found.select("path", F.col("sha256").alias("_f"))
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_f") == F.col("sha256"), "ok").otherwise("changed")
    return declared.join(held, "path", "left").withColumn("status", status).drop("_f")


def append_snapshot(history: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """History with the new snapshots that it lacks; a known id with another digest fails the job."""
    known = history.groupBy(key).agg(F.min(digest).alias("_d"))
    joined = new.join(known, key, "left")
    clash = F.col("_d").isNotNull() & (F.col("_d") != F.col(digest))
    fresh = joined.where(F.when(clash, F.raise_error(F.lit("a snapshot changed"))).otherwise(F.col("_d").isNull()).cast("boolean")).drop("_d")
    return history.unionByName(fresh)


def pseudonyms(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """Identities replaced by salted digests; all other columns stay as they are."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256)) for c in columns})
