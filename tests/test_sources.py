import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables as T
from tidemark.streaming import events as E


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "hi", twice\nplease', None), (1, "plain", 2.5)], "k long, text string, v double")
    T.write_csv(rows, f"{tmp_path}/out", ["k", "text", "v"], ["k"])
    back = T.read_csv(spark, f"{tmp_path}/out", "k long, text string, v double")
    assert [tuple(r) for r in back.orderBy("k").collect()] == [(1, "plain", 2.5), (2, 'say "hi", twice\nplease', None)]


def test_compressed_csv_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"k,v\n1,x\n,\n2,\"y\"\"z\"\n"))
    assert [tuple(r) for r in T.read_csv(spark, f"{tmp_path}/a.csv.gz", "k long, v string").orderBy("k").collect()] == [(1, "x"), (2, 'y"z')]
    (tmp_path / "b.csv").write_text("k,v\n1,x,extra\n")
    with pytest.raises(Exception):
        T.read_csv(spark, f"{tmp_path}/b.csv", "k long, v string").collect()


def test_manifest_and_verification(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a")
    found = T.manifest(spark, f"{tmp_path}/in")
    row = found.first()
    declared = spark.createDataFrame([(row.path, row.sha256), ("file:/none", "0")], "path string, sha256 string")
    assert {r.path: r.status for r in T.verify(declared, found).collect()} == {row.path: "ok", "file:/none": "missing"}


def test_snapshots_are_immutable(spark):
    schema = "id string, digest string"
    history = spark.createDataFrame([("a", "1")], schema)
    assert T.append_snapshot(history, spark.createDataFrame([("a", "1"), ("b", "2")], schema), "id", "digest").count() == 2
    with pytest.raises(Exception, match="snapshot changed"):
        T.append_snapshot(history, spark.createDataFrame([("a", "9")], schema), "id", "digest").collect()


def test_pseudonyms_leave_numbers_alone(spark):
    rows = spark.createDataFrame([("jo", 1.0), (None, 2.0)], "who string, v double")
    out = T.pseudonyms(rows, ["who"], "salt")
    assert out.select("v").exceptAll(rows.select("v")).count() == 0 and out.where(F.length("who") == 64).count() == 1


def test_streams_agree_with_batch(spark, tiny, tmp_path):
    events = T.table(spark, tiny, "events")
    first, second = events.where("event_id % 2 = 0"), events
    seen = {}
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = E.distinct_events(E.event_stream(spark, f"{tmp_path}/in"), "60 days")
        E.run_available(stream, f"{tmp_path}/check", lambda df, n: seen.update({(n, r.event_id): r.event_id for r in df.collect()}))
    assert sorted(seen.values()) == sorted(r.event_id for r in events.select("event_id").collect())
    totals = {}
    stream = E.windowed_totals(E.event_stream(spark, f"{tmp_path}/in"), "1 day", "60 days")
    E.run_available(stream, f"{tmp_path}/check2", lambda df, n: totals.update({(r.start, r.event_type): r.events for r in df.collect()}), "update")
    twice = events.where("event_id % 2 = 0").unionByName(events)
    assert totals == {(r.start, r.event_type): r.events for r in E.windowed_totals(twice, "1 day", "1 day").collect()}


def test_gzip_of_the_same_rows_is_the_same_bytes(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS k", "cast(id % 7 AS string) AS v")
    made = []
    for n in (1, 5):
        T.write_gzip_csv(rows.repartition(n), f"{tmp_path}/{n}", ["v", "k"], ["k"])
        made.append([f.read_bytes() for f in sorted((tmp_path / str(n)).glob("*.csv.gz"))])
    assert made[0] == made[1] and made[0]
