"""Rebuilding what depends on changed files: a log of listings, a state for each file, and the targets that a change reaches.

A poll appends to a log what a listing shows to be new, touched or gone since the last one; only such files are read, for their
digest. The log is a stream. Each file's last size, time and digest are kept as state, which tells a file with other bytes from one
that was merely touched, however often a poll or a batch is repeated. Changes then reach their targets through declared
dependencies, from target to target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.session import materialize, ship
from tidemark.streaming.events import run_available

LISTED = "poll long, path string, size long, modified timestamp, sha256 string"
CHANGES = "path string, change string, sha256 string, poll long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _logged(spark: SparkSession, log: str) -> DataFrame:
    try:
        return spark.read.schema(LISTED).parquet(log)
    except AnalysisException:  # no poll yet
        return spark.createDataFrame([], LISTED)


def record_listing(spark: SparkSession, folder: str, log: str) -> None:
    """One poll: append the files below a folder that are new or have another size or time, and those that are gone (size null).

    A poll that finds nothing new appends nothing. Files are listed by Spark; only appended ones are read.
    """
    held = _logged(spark, log)
    last = held.groupBy("path").agg(F.max_by(F.struct("size", "modified"), "poll").alias("_l"))
    poll = (held.agg(F.max("poll")).first()[0] or 0) + 1
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    now = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    met = now.join(last, "path", "full")
    other = met.where(~(F.col("size").eqNullSafe(F.col("_l.size")) & F.col("modified").eqNullSafe(F.col("_l.modified"))))
    changed = materialize(other.select("path", "size", "modified"))
    digests = found.join(changed.where("size is not null").select("path"), "path").select("path", F.sha2("content", 256).alias("sha256"))
    rows = materialize(changed.join(digests, "path", "left").select(F.lit(poll).cast("long").alias("poll"), "path", "size", "modified", "sha256"))
    if not rows.isEmpty():
        rows.write.mode("append").parquet(log)


class FileState(StatefulProcessor):
    """The last known digest of a file; says what a listed row changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "size long, sha256 string, poll long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for row in pd.concat(list(rows)).sort_values("poll").itertuples():
            held = self.last.get() if self.last.exists() else None
            if held is not None and row.poll <= held[2]:
                continue  # a poll that was seen before
            before, now = held[1] if held is not None else None, row.sha256 if isinstance(row.sha256, str) else None
            if before != now:
                out.append((key[0], "added" if before is None else "deleted" if now is None else "changed", now, row.poll))
            self.last.update((None if now is None else int(row.size), now, int(row.poll)))
        yield pd.DataFrame(out, columns=["path", "change", "sha256", "poll"])

    def close(self) -> None:
        pass


def file_changes(spark: SparkSession, log: str) -> DataFrame:
    """A stream of (path, change, sha256, poll): files whose bytes are new, other or gone. Touched files of the same bytes give nothing."""
    ship(spark)
    listed = spark.readStream.schema(LISTED).parquet(log)
    return listed.groupBy("path").transformWithStateInPandas(FileState(), CHANGES, "append", "none")


def affected_targets(changed: DataFrame, depends: DataFrame) -> DataFrame:
    """(target, because) for all targets that changed paths reach: `depends` has (source, target), and a target may be a source again.

    `because` is the smallest changed path that reaches the target. Cycles do no harm.
    """
    edges = depends.select("source", "target").distinct()
    reached = materialize(changed.select(F.col("path").alias("source"), F.col("path").alias("because")).join(edges, "source").groupBy("target").agg(F.min("because").alias("because")))
    while True:
        onward = reached.select(F.col("target").alias("source"), "because").join(edges, "source").select("target", "because")
        wider = materialize(reached.unionByName(onward).groupBy("target").agg(F.min("because").alias("because")))
        if wider.exceptAll(reached).isEmpty():
            return wider
        reached = wider


def rebuild(spark: SparkSession, folder: str, log: str, checkpoint: str, depends: DataFrame, build: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Poll once, then call `build` with the affected targets of each batch of changes; nothing changed, nothing is built.

    A call that is broken off goes on from the checkpoint; `build` may then see a batch again under the same number.
    """
    record_listing(spark, folder, log)
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)

    def each(changes: DataFrame, number: int) -> None:
        held = materialize(changes)
        targets = affected_targets(held, depends)
        if not targets.isEmpty():
            build(targets, number)

    try:
        return run_available(file_changes(spark, log), checkpoint, each)
    finally:
        spark.conf.set(_STORE, before)
