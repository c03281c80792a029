"""Session helpers shared by all operators."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED = "_tidemark_shipped"


def local_session(app: str = "tidemark", cpus: str = "*") -> SparkSession:
    """A local session with the settings the library expects (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent).as_posix())
    target = Path(tempfile.mkdtemp()) / "tidemark_workers.zip"
    target.write_bytes(blob.getvalue())
    context.addPyFile(str(target))
    setattr(context, _SHIPPED, True)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir. If that is unset, one beside the warehouse, which executors must share.

    A local session shares any folder; on a cluster a warehouse on the driver's own disk is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        master = spark.sparkContext.master
        if urlparse(root).scheme in ("", "file") and not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def materialize(df: DataFrame, partitioned_by: list[str] | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back, so that no lineage is needed to rebuild it.

    What :func:`discard` doesn't delete before goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    files, target = _files(spark, path)
    files.deleteOnExit(target)
    return out


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        files, target = _files(df.sparkSession, path)
        files.delete(target, True)


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a DataFrame's size in bytes (files on disk for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
