import bz2
import gzip
import hashlib
import io
import lzma
import zipfile
import zlib

import pytest
import zstandard

from tidemark.sources import tables as T
from tidemark.sources.transport import decode_transport, decoded, normalised_zip

TEXT = "﻿id,v\n1,é\n".encode()


def zipped(names, year):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(zipfile.ZipInfo(n, (year, 2, 3, 4, 5, 6)), f"content of {n}" * 50)
    return out.getvalue()


@pytest.mark.parametrize(
    ("data", "layers"),
    [
        (TEXT, []),
        (gzip.compress(TEXT), ["gzip"]),
        (gzip.compress(TEXT[:5]) + gzip.compress(TEXT[5:]) + b"\0" * 9, ["gzip"]),
        (bz2.compress(gzip.compress(zstandard.compress(TEXT))), ["bzip2", "gzip", "zstd"]),
        (lzma.compress(zlib.compress(TEXT)), ["xz", "zlib"]),
    ],
)
def test_layers_are_taken_off_and_recorded(data, layers):
    assert decoded(data, "id,v") == (TEXT, layers)


def test_what_is_not_expected_says_why(spark):
    rows = [(1, gzip.compress(TEXT), 5), (2, gzip.compress(TEXT)[:-9], 5), (3, b"\x00\x01", 5), (4, None, 5), (5, gzip.compress(b"other,v\n"), 5)]
    got = {r.k: r for r in decode_transport(spark.createDataFrame(rows, "k long, content binary, sign int"), "content", "id,v").collect()}
    assert bytes(got[1].content) == TEXT and got[1].layers == "gzip" and got[1].sha256 == hashlib.sha256(TEXT).hexdigest() and got[1].sign == 5 and got[1].error is None
    assert all(got[k].content is None and got[k].error for k in (2, 3, 4, 5))
    assert got[2].error.startswith("gzip: ") and got[4].error == "no payload" and "after gzip" in got[5].error


def test_zip_payloads_and_their_fixed_form():
    a, b = zipped(["x", "b/y"], 1999), zipped(["b/y", "x"], 2020)
    assert decoded(gzip.compress(a), "zip") == (a, ["gzip"])
    assert a != b and normalised_zip(a) == normalised_zip(b) == normalised_zip(normalised_zip(a))
    with zipfile.ZipFile(io.BytesIO(normalised_zip(a))) as z:
        assert z.namelist() == ["b/y", "x"] and z.read("x") == b"content of x" * 50


def test_columns_as_first_seen(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a")], "k int, b string"), spark.createDataFrame([(2, 0.5, "c")], "k int, z double, b string")
    both = T.first_seen_union(one, two)
    assert both.columns == ["k", "b", "z"]
    T.write_csv(both, f"{tmp_path}/out", None, ["k"])
    assert "".join(f.read_text() for f in sorted((tmp_path / "out").glob("*.csv"))).replace("k,b,z\n", "") == "1,a,\n2,c,0.5\n"


def test_a_cluster_needs_a_shared_folder():
    from tidemark.session import scratch_root

    class Fake:
        def __init__(self, master, **conf):
            self.sparkContext, self.conf = type("C", (), {"master": master}), type("F", (), {"get": staticmethod(lambda key, *default: conf.get(key.split(".")[1], *default))})

    assert scratch_root(Fake("local[4]", sql="file:/w")) == "file:/w/_scratch"
    assert scratch_root(Fake("yarn", sql="hdfs://n/w")) == "hdfs://n/w/_scratch" and scratch_root(Fake("yarn", sql="file:/w", checkpoint="/shared/")) == "/shared"
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://h:7077"):
        with pytest.raises(ValueError, match="share"):
            scratch_root(Fake(master, sql="file:/w"))
