import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources.once import MANIFEST, WrittenOtherwise, _Writer, changed_files, read_once, write_once


def files(path):
    return sorted(str(f.relative_to(path)) for f in path.rglob("*"))


@pytest.fixture
def rows(spark):
    return spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("é"), F.col("id"))).alias("text"), (F.col("id") / 3).alias("v"), F.array("id").alias("list"))


def test_the_same_rows_are_one_write(spark, rows, tmp_path):
    at = tmp_path / "frozen"
    write_once(rows.repartition(5), str(at))
    before = files(at), (at / MANIFEST).read_bytes()
    write_once(rows.orderBy(F.desc("k")).coalesce(2), f"file://{at}")
    assert (files(at), (at / MANIFEST).read_bytes()) == before
    back = read_once(spark, str(at))
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert back.exceptAll(rows).count() == 0 and back.count() == 300 and changed_files(str(at)) == []


def test_other_rows_are_refused_and_leave_nothing(spark, rows, tmp_path):
    at = tmp_path / "frozen"
    write_once(rows, str(at))
    before = files(at)
    twice = rows.unionByName(rows.where("k = 3"))
    for other in (rows.where("k > 0"), rows.withColumn("v", F.when(F.col("k") == 9, -1.0).otherwise(F.col("v"))), twice, rows.drop("list"), rows.withColumnRenamed("v", "w")):
        with pytest.raises(Exception, match="never overwritten"):
            write_once(other, str(at))
        assert files(at) == before
    assert read_once(spark, str(at)).count() == 300


def test_a_failed_task_leaves_nothing(spark, rows, tmp_path):
    at = tmp_path / "frozen"
    bad = rows.repartition(6).withColumn("v", F.when(F.col("k") == 250, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken row"):
        write_once(bad, str(at))
    assert not at.exists() or files(at) == []
    write_once(rows, str(at))
    assert read_once(spark, str(at)).count() == 300


def test_no_rows_and_changed_files(spark, rows, tmp_path):
    write_once(rows.where("false"), str(tmp_path / "none"))
    assert read_once(spark, str(tmp_path / "none")).count() == 0
    at = tmp_path / "some"
    write_once(rows.coalesce(1), str(at))
    (name,) = [f["name"] for f in json.loads((at / MANIFEST).read_text())["files"]]
    (at / name).write_bytes(b"x")
    assert changed_files(str(at)) == [name]
    with pytest.raises(Exception, match="mounted"):
        write_once(rows, "s3://bucket/x")


def test_of_two_writers_one_publishes(rows, tmp_path):
    """Both pass the first look; the link decides."""
    from tidemark.sources.once import Written

    ends, gate = [], threading.Barrier(2)

    class Slow(_Writer):
        def _known(self, digest):
            known = super()._known(digest)
            if not known:
                gate.wait(timeout=20)
            return known

    def run(total):
        writer = Slow(tmp_path / "race", rows.schema)
        (writer.staging / "p").write_text("x")
        try:
            writer.commit([Written("p", 1, total, "0")])
            ends.append("published")
        except WrittenOtherwise:
            ends.append("refused")

    threads = [threading.Thread(target=run, args=(t,)) for t in (1, 2)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(ends) == ["published", "refused"]
    assert len([f for f in files(tmp_path / "race") if f.endswith("/p")]) == 1
