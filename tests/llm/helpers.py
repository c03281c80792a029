"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, tag int, fp string, part string, key string, value string"

PASSAGE = "the harbour lights went out one by one while the night watchman counted barrels along the eastern quay"
ODD_TEXTS = [
    (1, "Plain words stand here, and more plain words follow them. " * 6),
    (2, "Plain words stand here, and more plain words follow them. " * 6),
    (3, None),
    (4, ""),
    (5, " \t\n\r\x0b\x0c"),
    (6, "one"),
    (7, "Straße ΟΔΟΣ ﬁn é naïve   日本語 emoji 👩‍👩‍👧 \x1c\x1d done"),
    (8, "A lone line\nA lone line\n\n  \nA lone line\nend"),
    (9, f"start {PASSAGE} finish"),
    (10, f"{PASSAGE} and then something else {PASSAGE}"),
    (11, "x" * 5000),
    (12, " ".join(f"w{i % 977}" for i in range(30_000))),
    (12, " ".join(f"w{i % 977}" for i in range(30_000))),
    (13, "<|endoftext|> is <|startoftext|>not<|endoftext|> special? 'tis they're 12,345.67"),
    (14, "you are an id1ot and a m0ron, you stupid scum"),
]


def docs(spark: SparkSession, rows=None) -> DataFrame:
    """Rows of (doc_id, text) as documents with extra columns whose names clash with the operators' own."""
    rows = ODD_TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", "s", len(t or ""), "b", k, "f", "p", "k", "v") for k, (i, t) in enumerate(rows)], SCHEMA)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
