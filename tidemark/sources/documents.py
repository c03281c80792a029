"""Sources inside documents: nested payloads, tables in markup, strict line grammars and records of fixed stride.

A file is read as one row of text (`wholetext`), and Spark's functions take it apart; many files are many rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import key_part, magnitude, normal_key
from tidemark.session import ship


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents (also compressed), one or an array of them in each file, under a schema of structs, arrays and maps."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def tier_rows(df: DataFrame, keys: list[str], by_tier: str, default: str) -> DataFrame:
    """A map keyed 'endpoint::tier' as rows of endpoint, tier and the value's fields; an empty map gives none."""
    rows = df.select(*keys, F.explode(by_tier).alias("_k", "_v"))
    return rows.select(*keys, key_part(F.col("_k"), 1, "").alias("endpoint"), key_part(F.col("_k"), 2, default).alias("tier"), "_v.*")


def item_rows(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    """An array of structs as rows; a document without items stays, with nulls."""
    return df.select(*keys, F.explode_outer(items).alias("_i")).select(*keys, "_i.*")


def lines(texts: DataFrame) -> DataFrame:
    """path, line (from 0) and value of every line."""
    return texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "value"))


def fixed_stride(texts: DataFrame, first: str, last: str, fields: list[str]) -> DataFrame:
    """Records of as many lines as there are fields, between a line that equals `first` and one that equals `last`.

    A file without both, or whose lines between them don't fill whole records, fails.
    """
    parts = F.split("text", r"\r?\n")
    start, stop = F.array_position(parts, first), F.array_position(parts, last)
    n = stop - start - 1
    bad = (start == 0) | (stop <= start) | (n % len(fields) != 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no whole records in "), F.col("path")))).otherwise(F.slice(parts, (start + 1).cast("int"), n.cast("int")))
    each = texts.select("path", F.posexplode(checked).alias("_p", "_v"))
    record = F.floor(F.col("_p") / len(fields))
    return each.groupBy("path", record.cast("int").alias("record")).agg(*(F.max(F.when(F.col("_p") % len(fields) == i, F.col("_v"))).alias(f) for i, f in enumerate(fields)))


def latex_rows(texts: DataFrame, label: str) -> DataFrame:
    """The rows of the LaTeX table with a label as cells without macros: path, row, cells."""
    body = F.regexp_extract("text", r"(?s)\\begin\{table\*?\}((?:(?!\\end\{table).)*\\label\{" + label + r"\}(?:(?!\\end\{table).)*)\\end\{table", 1)
    each = texts.select("path", F.posexplode(F.filter(F.split(body, r"\\\\"), lambda x: x.contains("&"))).alias("row", "_t"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("_t", r"(?s)^.*\\(?:top|mid|bottom)rule|\\hline", ""), r"\\[a-zA-Z]+\*?\{([^{}]*)\}", "$1"), r"\\([%&#_$])", "$1")
    marked = F.regexp_replace(plain, r"[{}$~]", " ")
    return each.select("path", "row", F.transform(F.split(marked, "&"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))).alias("cells"))


def estimate(cell: Column) -> Column:
    """'12 [3, 40]' or '1.5k' as a struct of value, low and high; parts that aren't there are null."""
    bounds = r"\[\s*([^,\]]+)\s*,\s*([^\]]+)\s*\]"
    return F.struct(magnitude(F.regexp_extract(cell, r"^([^\[]*)", 1)).alias("value"), magnitude(F.regexp_extract(cell, bounds, 1)).alias("low"), magnitude(F.regexp_extract(cell, bounds, 2)).alias("high"))


def pushed_objects(pages: DataFrame, keys: list[str], html: str, call: str, schema: str, identity: str, core: list[str]) -> DataFrame:
    """JSON objects in the string arguments that scripts push: of each identity the most complete one.

    `schema` is of one object. Objects of one identity whose core fields differ (a null differs from none) fail the job.
    """
    strings = F.regexp_extract_all(html, F.lit(call + r'\(\s*"((?:[^"\\]|\\.)*)"\s*\)'), F.lit(1))
    pushed = pages.select(*keys, F.explode(strings).alias("_s"))
    texts = pushed.select(*keys, F.from_json(F.concat(F.lit('{"t":"'), F.col("_s"), F.lit('"}')), "t string")["t"].alias("_t"))
    objects = texts.select(*keys, F.explode(F.regexp_extract_all("_t", F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("_o"))
    parsed = objects.select(*keys, F.from_json("_o", schema).alias("_j")).select(*keys, "_j.*").where(F.col(identity).isNotNull())
    fields = [c for c in parsed.columns if c not in keys]
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    every = Window.partitionBy(identity)
    clash = [F.coalesce(F.min(c).over(every) != F.max(c).over(every), F.lit(False)) for c in core]
    marked = parsed.withColumn("_n", filled).withColumn("_clash", F.array_max(F.array(F.lit(False), *clash)))
    checked = marked.where(F.when(F.col("_clash"), F.raise_error(F.concat(F.lit("core fields differ for "), F.col(identity).cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    best = Window.partitionBy(identity).orderBy(F.desc("_n"), *keys, *(F.asc(c) for c in fields))
    return checked.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(identity, *(c for c in fields if c != identity))


def strict_scalars(texts: DataFrame, productions: dict[str, str], wanted: list[str]) -> DataFrame:
    """Scalars of files whose every line must match a production (name to pattern, whose first group is the value).

    A line of no production, or a wanted production that a file doesn't hold exactly once, fails.
    """
    each = lines(texts).where(F.trim("value") != "")
    kind = F.coalesce(*(F.when(F.regexp_like("value", F.lit(p)), n) for n, p in productions.items()))
    named = each.withColumn("_k", kind)
    named = named.withColumn("_k", F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("no production for line: "), F.col("value")))).otherwise(F.col("_k")))
    found = named.groupBy("path").agg(
        *(F.count_if(F.col("_k") == n).alias(f"_{n}") for n in wanted), *(F.max(F.when(F.col("_k") == n, F.trim(F.regexp_extract("value", productions[n], 1)))).alias(n) for n in wanted)
    )
    once = [F.when(F.col(f"_{n}") == 1, F.col(n)).otherwise(F.raise_error(F.concat(F.lit(f"not exactly one {n} in "), F.col("path")))).alias(n) for n in wanted]
    return found.select("path", *once)


def pipe_tables(texts: DataFrame, least_cells: int) -> DataFrame:
    """Rows of Markdown tables as cells, with a key from the first; separators, headers and short rows are left out, and a key that repeats in a file fails."""
    held = lines(texts).where(F.trim("value").startswith("|"))
    after = Window.partitionBy("path").orderBy("line")
    rule = F.regexp_like("value", F.lit(r"^\s*\|[\s:|-]+\|\s*$"))
    marked = held.withColumn("_rule", rule).withColumn("_header", F.coalesce(F.lead("_rule").over(after), F.lit(False)))
    bare = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    cells = F.transform(F.split(bare, r"\|"), lambda c: F.trim(c))
    rows = marked.where("not _rule and not _header").select("path", "line", cells.alias("cells")).where(F.size("cells") >= least_cells)
    keyed = rows.withColumn("key", normal_key(F.col("cells")[0])).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path", "key")))
    return keyed.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("a label repeats: "), F.col("key"))).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def _flatten(value, at: str, out: list[tuple[str, str]]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _flatten(v, at + "/" + str(k).replace("~", "~0").replace("/", "~1"), out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _flatten(v, f"{at}/{i}", out)
    elif value is not None:
        out.append((at, str(int(value)) if isinstance(value, bool) else str(value)))


def deep_leaves(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every leaf of JSON texts at any depth: its pointer, its text (true and false as 1 and 0) and its number, if it is one.

    Nulls are no leaves; a text that is no JSON gives none. The walk is one small function inside an Arrow map, since SQL has no recursion.
    """
    ship(df.sparkSession)
    source = df.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "pointer string, value_text string"])

    def run(frames):
        for frame in frames:
            found: list[list[tuple[str, str]]] = []
            for raw in frame["_text"]:
                out: list[tuple[str, str]] = []
                try:
                    _flatten(json.loads(raw), "", out)
                except (TypeError, ValueError):
                    out = []
                found.append(out)
            counts = [len(x) for x in found]
            rows = frame[keys].loc[frame.index.repeat(counts)].reset_index(drop=True)
            flat = [leaf for x in found for leaf in x]
            yield rows.assign(pointer=pd.Series([p for p, _ in flat], dtype="object"), value_text=pd.Series([v for _, v in flat], dtype="object"))

    return source.mapInPandas(run, schema).withColumn("value", F.col("value_text").try_cast("double"))


def declared_digests(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of path and SHA-256 that JSON documents declare, from their leaves (`keys`, pointer, value_text).

    A digest beside a leaf named path, file or name belongs to that one; any other digest belongs to its own key, if that looks like a path.
    """
    split = leaves.select(*keys, F.regexp_extract("pointer", r"^(.*)/[^/]*$", 1).alias("_parent"), F.regexp_extract("pointer", r"([^/]*)$", 1).alias("_name"), "value_text")
    digests = split.where(F.regexp_like("value_text", F.lit("^[0-9a-f]{64}$")))
    beside = split.where(F.col("_name").isin("path", "file", "name")).groupBy(*keys, "_parent").agg(F.min(F.struct(F.array_position(F.array(*map(F.lit, ("path", "file", "name"))), F.col("_name")).alias("o"), "value_text"))["value_text"].alias("_beside"))
    own = F.replace(F.replace("_name", F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    joined = digests.join(beside, [*keys, "_parent"], "left")
    return joined.select(*keys, F.coalesce("_beside", F.when(own.contains("."), own)).alias("path"), F.col("value_text").alias("sha256")).where("path is not null").distinct()
