import os

from tidemark.streaming.rebuild import affected_targets, rebuild, record_listing


def test_only_what_depends_on_changes_is_built(spark, tmp_path):
    source, log, state = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "state")
    source.mkdir()
    name = lambda f: f"file:{source}/{f}"
    for f in "abc":
        (source / f"{f}.txt").write_text(f)
    edges = [(name("a.txt"), "t1"), (name("b.txt"), "t2"), ("t1", "report"), ("t2", "summary"), (name("c.txt"), "t3"), ("report", "t1"), (name("d.txt"), "t4")]
    depends = spark.createDataFrame(edges, "source string, target string")
    built = []

    def poll():
        built.clear()
        rebuild(spark, str(source), log, state, depends, lambda df, n: built.extend((r.target, r.because.rsplit("/", 1)[-1]) for r in df.collect()))
        return sorted(built)

    assert poll() == [("report", "a.txt"), ("summary", "b.txt"), ("t1", "a.txt"), ("t2", "b.txt"), ("t3", "c.txt")]
    assert poll() == []
    (source / "a.txt").write_text("other")
    os.utime(source / "b.txt", (10**9, 10**9))  # touched, the same bytes
    (source / "c.txt").unlink()
    (source / "d.txt").write_text("d")
    assert poll() == [("report", "a.txt"), ("t1", "a.txt"), ("t3", "c.txt"), ("t4", "d.txt")]
    assert poll() == []
    (source / "c.txt").write_text("c")  # back again
    assert poll() == [("t3", "c.txt")]


def test_a_poll_reads_only_what_is_new_or_touched(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    (source / "a").write_text("1"), (source / "b").write_text("2")
    for _ in range(2):
        record_listing(spark, str(source), log)
    (source / "a").write_text("11")
    record_listing(spark, str(source), log)
    rows = spark.read.parquet(log).collect()
    assert sorted((r.poll, r.path.rsplit("/", 1)[-1], r.size) for r in rows) == [(1, "a", 1), (1, "b", 1), (2, "a", 2)]


def test_targets_without_sources(spark):
    changed = spark.createDataFrame([("x",)], "path string")
    assert affected_targets(changed, spark.createDataFrame([("y", "t")], "source string, target string")).count() == 0
