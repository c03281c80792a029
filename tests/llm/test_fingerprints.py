import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import docs, read
from tidemark.llm.fingerprints import BINS, MARK, bucketed, document_fingerprints, likeness, probe_tables, with_fingerprint
from tidemark.llm.queries import op13_one_permutation_minhash


def h64(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def chain(numbers):
    out = 42
    for v in numbers:
        out = h64(struct.pack("<q", v), out)
    return signed(out)


def plain_bins(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w] or [""]
    hashes = [signed(h64(w.encode(), 42)) for w in words]
    shingles = [chain(hashes[i : i + 5]) for i in range(max(len(hashes) - 4, 1))]
    bins = [None] * BINS
    for h in shingles:
        i = (h >> 56) + 128
        bins[i] = h if bins[i] is None else min(bins[i], h)
    return bins


def plain_fingerprint(text):
    bins = plain_bins(text)
    full = [i for i, v in enumerate(bins) if v is not None]

    def ranked(i):
        return min((chain2(j, i) & ~255) | j for j in full) & 255

    def chain2(j, i):  # a long, then an int
        return signed(h64(struct.pack("<i", i), h64(struct.pack("<q", j), 42)))

    out = []
    for i, v in enumerate(bins):
        tried = (t[i] for t in probe_tables())
        at = i if v is not None else next((j for j in tried if bins[j] is not None), None)
        out.append(bins[ranked(i) if at is None else at] & 15)
    return "".join(f"{v:x}" for v in out)


def plain_likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / BINS - 1 / 16) / (1 - 1 / 16))


def plain(rows):
    """Results of rows (doc_id, text), by the plain rule."""
    tie = lambda text: signed(h64(text.encode(), 42))
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(following)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, plain_likeness(own, other), plain_likeness(own, after)))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")) + (round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bucket_rows", [1, 3, 250])
def test_odd_texts_against_plain_code(spark, bucket_rows):
    table = docs(spark)
    expected = sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in plain([(r.doc_id, r.text) for r in table.collect()])), key=repr)
    assert rows_of(document_fingerprints(table, bucket_rows)) == expected


@pytest.mark.parametrize("bucket_rows", [2, 1000])
def test_null_and_repeated_ids(spark, bucket_rows):
    rows = [(None, "a b c"), (None, None), (None, "a b c"), (5, "x y"), (5, "z"), (5, "x y"), (5, "u v w"), (5, "t"), (-3, "low id " * 9), (1 << 60, "high id " * 9)]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, guest int")
    expected = sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in plain(rows)), key=repr)
    assert rows_of(document_fingerprints(table, bucket_rows)) == expected


def test_single_row_and_empty_table(spark):
    one = spark.createDataFrame([(7, "just this one text of nine words stands here")], "doc_id long, text string")
    assert rows_of(document_fingerprints(one)) == sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in plain([(7, one.first().text)])], key=repr)
    assert document_fingerprints(one.where("false")).count() == 0


def test_buckets_are_even_and_in_order(spark, small):
    rows = read(spark, small, "documents").select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ranges = bucketed(rows, 50).groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).orderBy("bucket").collect()
    assert len(ranges) >= 15 and max(r.n for r in ranges) <= 100
    assert all(a.low > b.high for a, b in zip(ranges, ranges[1:]))
    same = spark.range(400).select(F.lit(9).cast("long").alias("doc_id"), F.lit("").alias("text"), F.xxhash64("id").alias("tie"))
    assert bucketed(same, 50).select("bucket").distinct().count() == 7  # as many as there are edges


def test_likeness_is_close_to_the_share_of_common_shingles(spark, small):
    got = {r.doc_id: r for r in op13_one_permutation_minhash(spark, small).collect()}
    texts = {r.doc_id: r.text or "" for r in read(spark, small, "documents").collect()}
    ids = sorted(texts, reverse=True)
    assert got.keys() == texts.keys()

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}

    errors, same = [], 0
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, half = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got[i].near_edited), (texts[after], got[i].near_next)):
            a, b = shingles(text), shingles(other)
            errors.append(near - len(a & b) / len(a | b))
            if text == other:
                assert near == 1
                same += 1
    assert abs(sum(errors)) / len(errors) < 0.005
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.04


def test_probes_and_marks():
    tables = probe_tables()
    assert len(tables) == 16 and all(0 <= j < BINS for t in tables for j in t) and MARK == (1 << 56) - 1


def test_native_plan(spark, tiny):
    plan = op13_one_permutation_minhash(spark, tiny)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_likeness_bounds(spark):
    df = spark.createDataFrame([("one two three four five six",), ("",)], "t string")
    got = with_fingerprint(with_fingerprint(df, "t", "a"), "t", "b").select(likeness("a", "b").alias("v")).collect()
    assert [r.v for r in got] == [1.0, 1.0]
