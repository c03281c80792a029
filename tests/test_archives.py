import gzip
import hashlib
import io
import re
import tarfile
import zipfile

import pytest

from tidemark.sources import archives as A
from tidemark.sources import tables as T

DEFLATED, STORED = zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED


def zipped(files, how=DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(files, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def csv_of(k):
    return ("id,text,v\r\n" + "".join(f'{i},"say ""{k}"",\nline {i}",{i * k}\r\n' for i in range(5)) + ",,\r\n").encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    days = {f"days/snapshot_2024-01-0{k}.zip": zipped({"runs.csv": csv_of(k), "notes/read.txt": b"notes", "empty.csv": b""}, STORED if k == 2 else DEFLATED) for k in (1, 2, 3)}
    (at / "plain.zip").write_bytes(zipped({"a.csv": csv_of(1), "b/c.csv": csv_of(2), "skip.bin": b"x" * 9000, "deep.zip": zipped({"d.csv": csv_of(3)}), "dir/": b""}))
    (at / "stored.zip").write_bytes(zipped({**days, "inner.tar.gz": tarred({"e.csv": csv_of(4)}, "w:gz")}, STORED))
    (at / "all.tar").write_bytes(tarred({**days, "f.csv": csv_of(5)}))
    (at / "all.tar.gz").write_bytes(tarred({**days, "f.csv": csv_of(5)}, "w:gz"))
    return str(at)


def test_members_of_all_kinds(spark, folder):
    got = {(r.archive.rsplit("/", 1)[-1], r.member): r for r in A.read_archives(spark, folder, "*.csv").collect()}
    nested = {f"days/snapshot_2024-01-0{k}.zip!{f}" for k in (1, 2, 3) for f in ("runs.csv", "empty.csv")}
    expected = {("plain.zip", m) for m in ("a.csv", "b/c.csv", "deep.zip!d.csv")} | {("stored.zip", m) for m in nested | {"inner.tar.gz!e.csv"}}
    expected |= {(a, m) for a in ("all.tar", "all.tar.gz") for m in nested | {"f.csv"}}
    assert got.keys() == expected
    for (_, member), r in got.items():
        k = 0 if "empty" in member else int((re.search(r"0(\d)\.zip", member) or [0, {"a": 1, "b": 2, "d": 3, "e": 4, "f": 5}[member.rsplit("!")[-1][0]]])[1])
        assert bytes(r.content) == (csv_of(k) if k else b"") and r.sha256 == hashlib.sha256(r.content).hexdigest() and r.bytes == len(r.content) and r.error is None


def test_each_member_is_a_task_unless_asked_otherwise(spark, folder):
    at = f"{folder}/stored.zip"
    assert A.read_archives(spark, at, "*.csv").rdd.getNumPartitions() == 5 + 2  # stored day 2 is gone into, the others are streamed
    assert A.read_archives(spark, at, "*.csv", task_bytes=1 << 30).rdd.getNumPartitions() == 1
    assert A.read_archives(spark, f"{folder}/plain.zip", "*.csv", containers="none").rdd.getNumPartitions() == 2


def test_what_is_not_wanted_is_not_read(folder, monkeypatch):
    taken = []
    plain = A._Window.readinto
    monkeypatch.setattr(A._Window, "readinto", lambda self, buffer: taken.append(got := plain(self, buffer)) or got)
    reader = A._Reader({"path": f"{folder}/plain.zip", "members": "a.csv", "containers": "none"})
    (task,) = reader.partitions()
    assert [b.column("member").to_pylist() for b in reader.read(task)] == [["a.csv"]]
    assert sum(taken) < 400


def test_csv_rows_and_snapshots(spark, folder):
    rows = A.read_archived_csv(spark, f"file:{folder}/all.tar.gz", ["v", "text"], "*runs.csv").withColumn("snapshot", A.snapshot_of(A.F.col("member")))
    got = sorted((r.snapshot, r.line, r.text, r.v) for r in rows.collect())
    assert got == sorted((f"2024-01-0{k}", i + 1, f'say "{k}",\nline {i}', str(i * k)) for k in (1, 2, 3) for i in range(5))


def test_declared_digests_and_missing_tables(spark, folder):
    days = A.read_archives(spark, f"{folder}/all.tar.gz", "*.zip", containers="*.gz").select(A.F.col("member").alias("path"), "sha256")
    found = {r.path: r.sha256 for r in days.collect()}
    assert len(found) == 3
    declared = spark.createDataFrame([(p, d if "01-02" not in p else "0") for p, d in found.items()], "path string, sha256 string")
    assert sorted(r.status for r in T.verify(declared, days).collect()) == ["changed", "ok", "ok"]
    members = A.read_archives(spark, f"{folder}/all.tar.gz", "*!*").withColumn("snapshot", A.snapshot_of(A.F.col("member")))
    lacks = A.missing_members(members, "snapshot", ["runs.csv", "models.csv"]).collect()
    assert sorted((r.snapshot, r.name) for r in lacks) == [(f"2024-01-0{k}", "models.csv") for k in (1, 2, 3)]


def spoiled(data, near, by=3):
    at = data.index(near) + by
    return data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :]


def test_a_corrupt_member_is_named(spark, tmp_path):
    good, bad = b"k,v\n1,fine\n", b"k,v\n2,spoiledspoiled\n"
    (tmp_path / "x.zip").write_bytes(spoiled(zipped({"good.csv": good, "bad.csv": bad}, STORED), b"2,spoiled"))
    (tmp_path / "y.tar.gz").write_bytes(tarred({"in/z.zip": spoiled(zipped({"bad.csv": bad, "good.csv": good}, STORED), b"2,spoiled")}, "w:gz"))
    (tmp_path / "cut.zip").write_bytes(zipped({"a.csv": good})[:40])
    for name, member in (("x.zip", "x.zip!bad.csv"), ("y.tar.gz", "y.tar.gz!in/z.zip!bad.csv"), ("cut.zip", "cut.zip")):
        with pytest.raises(Exception, match=re.escape(member)):
            A.read_archives(spark, f"{tmp_path}/{name}").collect()
    with pytest.raises(Exception, match=re.escape("x.zip!bad.csv")):
        A.read_archived_csv(spark, f"{tmp_path}/x.zip", ["k"]).collect()
    got = {(r.member or r.archive).rsplit("/", 1)[-1].removeprefix("z.zip!"): (r.content is not None, r.error is not None) for r in A.read_archives(spark, str(tmp_path), permissive=True).collect()}
    assert got["bad.csv"] == (False, True) and got["good.csv"] == (True, False) and got["cut.zip"] == (False, True)


def test_wrong_tables_are_named(spark, tmp_path):
    (tmp_path / "w.zip").write_bytes(zipped({"wide.csv": b"k,v\n1,2,3\n", "other.csv": b"k\n1\n"}))
    for member, columns in (("wide.csv", ["k"]), ("other.csv", ["k", "v"])):
        with pytest.raises(Exception, match=member):
            A.read_archived_csv(spark, f"{tmp_path}/w.zip", columns, member).collect()
    with pytest.raises(Exception, match="archive's name"):
        (tmp_path / "t.gz").write_bytes(gzip.compress(b"x"))
        A.read_archives(spark, f"{tmp_path}/t.gz").collect()
