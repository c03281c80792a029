"""A sink whose tables are written once: the same rows again change nothing, other rows are refused.

Tasks write Parquet files into a staging folder that only this write knows. The commit adds up the tasks' row digests, which
don't depend on order or partitions, moves the folder under its final name, and publishes it by one manifest, which is linked
into place only if there is none. Readers go by the manifest, so they see all of a write or nothing of it.

The folder has to be on a file system that all executors share under the same path (links are what makes publishing atomic).
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.session import ship

MANIFEST = "manifest.json"
DIGEST = "_once_digest"
SPACE = 1 << 256


def _folder(path: str) -> Path:
    """A path without its file scheme; others aren't file systems with links."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"{path} is no absolute path of a mounted file system")
    return Path(path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its file (None if it had no rows), rows, and the sum of their digests."""

    file: str | None
    rows: int
    total: int
    sha256: str | None


class WrittenOtherwise(ValueError):
    """A table of this name exists, with other rows."""


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: Path, schema: StructType):
        self.folder, self.fields = folder, [f.simpleString() for f in schema.fields if f.name != DIGEST]
        self.staging = folder / f".staging-{uuid.uuid4().hex}"
        self.staging.mkdir(parents=True)  # here and not in tasks: one that outlives an abort can't bring it back

    def _clear(self) -> None:
        """Take the staging folder away, with what tasks that are being ended still write into it."""
        gone = self.folder / f".aborted-{uuid.uuid4().hex}"
        try:
            os.replace(self.staging, gone)
        except FileNotFoundError:
            return
        shutil.rmtree(gone, ignore_errors=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file; a task that fails takes its part of it away."""
        path, rows, total, out = self.staging / f"part-{uuid.uuid4().hex}.parquet", 0, 0, None
        try:
            for part in iterator:
                at = part.schema.get_field_index(DIGEST)
                for digest in part.column(at).to_pylist():
                    total = (total + int.from_bytes(digest, "big")) % SPACE
                rows += part.num_rows
                kept = part.drop_columns([DIGEST])
                if out is None:
                    out = pq.ParquetWriter(path, kept.schema)
                out.write_batch(kept)
            if out is None:
                return Written(None, 0, 0, None)
            out.close()
        except BaseException:
            if out is not None:
                out.close()
                path.unlink(missing_ok=True)
            raise
        with path.open("rb") as file:
            return Written(path.name, rows, total, hashlib.file_digest(file, "sha256").hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m and m.file), key=lambda m: m.file)
        total = sum(m.total for m in parts) % SPACE
        said = f"{json.dumps(self.fields)}|{sum(m.rows for m in parts)}|{total:064x}"
        digest = hashlib.sha256(said.encode()).hexdigest()
        try:
            if self._known(digest):
                return
            kept = {m.file for m in parts}
            data = self.folder / f"data-{uuid.uuid4().hex}"
            if parts:
                os.replace(self.staging, data)
                for left in data.iterdir():  # of attempts that weren't taken
                    if left.name not in kept:
                        left.unlink()
            files = [{"name": f"{data.name}/{m.file}", "rows": m.rows, "sha256": m.sha256} for m in parts]
            draft = self.folder / f".manifest-{uuid.uuid4().hex}"
            draft.write_text(json.dumps({"fields": self.fields, "rows": sum(m.rows for m in parts), "digest": digest, "files": files}, indent=1))
            try:
                os.link(draft, self.folder / MANIFEST)  # fails if another write was first
            except FileExistsError:
                shutil.rmtree(data, ignore_errors=True)
                self._known(digest)
            finally:
                draft.unlink()
        finally:
            self._clear()

    def _known(self, digest: str) -> bool:
        """Whether these rows are published already; fails if others are."""
        path = self.folder / MANIFEST
        if not path.exists():
            return False
        if json.loads(path.read_text())["digest"] != digest:
            raise WrittenOtherwise(f"{self.folder} holds other rows and is never overwritten")
        return True

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class OnceSource(DataSource):
    """Writing only: option path; the rows carry their digests in DIGEST."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_once"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(_folder(self.options["path"]), schema)


def write_once(df: DataFrame, path: str) -> None:
    """Publish rows under a path, or leave what is there if it has the same rows and fields; fails if it has others.

    Rows are compared as JSON by SHA-256, in any order and partitioning; rows that occur more than once count as often.
    """
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(OnceSource)
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    df.withColumn(DIGEST, F.unhex(F.sha2(text, 256))).write.format(OnceSource.name()).mode("append").save(path)


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """The rows published under a path; a path without a manifest fails."""
    folder = _folder(path)
    manifest = json.loads((folder / MANIFEST).read_text())
    schema = ", ".join("`{}` {}".format(*f.split(":", 1)) for f in manifest["fields"])
    files = [f"file://{folder}/{f['name']}" for f in manifest["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def changed_files(path: str) -> list[str]:
    """Published files whose bytes are gone or aren't those of the manifest; read one after the other on the driver."""
    folder, out = _folder(path), []
    for entry in json.loads((folder / MANIFEST).read_text())["files"]:
        file = folder / entry["name"]
        if not file.exists() or hashlib.file_digest(file.open("rb"), "sha256").hexdigest() != entry["sha256"]:
            out.append(entry["name"])
    return out
