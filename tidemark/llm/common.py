"""What the operators of this package share: the word rule, table access and Arrow mapping."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship

#: Words are runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: Rows that one step inside a task handles together, so that a batch of long texts stays small.
STEP_ROWS = 1024

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow after this package was sent to the workers; batches are cut to STEP_ROWS rows."""
    ship(df.sparkSession)

    def run(batches):
        return function(cut for batch in batches for cut in slices(batch))

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch(**columns) -> pa.RecordBatch:
    """A record batch of Arrow arrays, in the order given."""
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
