import gzip
import json

import pytest

from tidemark.sources import documents as D
from tidemark.sources import tables as T


def write(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return str(folder)


def test_payloads(spark, tmp_path):
    body = {"id": "m1", "items": [{"name": "a", "price": 1.5}, {"name": "b", "price": None}], "tiers": {"e1::fast": {"calls": 3}, "e2": {"calls": 4}}}
    (tmp_path / "p.json.gz").write_bytes(gzip.compress(json.dumps([body, {"id": "m2"}]).encode()))
    got = D.read_payloads(spark, str(tmp_path), "id string, items array<struct<name: string, price: double>>, tiers map<string, struct<calls: int>>")
    assert sorted(map(tuple, D.item_rows(got, ["id"], "items").collect()), key=str) == [("m1", "a", 1.5), ("m1", "b", None), ("m2", None, None)]
    assert sorted(map(tuple, D.tier_rows(got, ["id"], "tiers", "standard").collect())) == [("m1", "e1", "fast", 3), ("m1", "e2", "standard", 4)]


def test_fixed_stride(spark, tmp_path):
    good = D.whole_texts(spark, write(tmp_path, a__txt="head\nSTART\nx\n1\ny\n2\nEND\nfoot"))
    assert sorted((r.record, r.name, r.value) for r in D.fixed_stride(good, "START", "END", ["name", "value"]).collect()) == [(0, "x", "1"), (1, "y", "2")]
    with pytest.raises(Exception, match="no whole records"):
        D.fixed_stride(good, "START", "END", ["a", "b", "c"]).collect()
    with pytest.raises(Exception, match="no whole records"):
        D.fixed_stride(good, "NEVER", "END", ["a", "b"]).collect()


def test_latex(spark, tmp_path):
    text = r"""\begin{table} other & row \\ \label{tab:no} \end{table}
\begin{table*}\caption{x}\label{tab:yes}\begin{tabular}{lr}\toprule Name & Size \\ \midrule
\textbf{Alpha} & 12 [3, 40] \\ Beta\_x & 1.5k \\ \bottomrule\end{tabular}\end{table*}"""
    rows = D.latex_rows(D.whole_texts(spark, write(tmp_path, a__tex=text)), "tab:yes")
    assert [r.cells for r in rows.orderBy("row").collect()] == [["Name", "Size"], ["Alpha", "12 [3, 40]"], ["Beta_x", "1.5k"]]
    found = rows.where("row > 0").orderBy("row").select(D.estimate(rows.cells[1]).alias("e")).collect()
    assert [tuple(r.e) for r in found] == [(12.0, 3.0, 40.0), (1500.0, None, None)]


def page(*objects):
    return "".join(f"<script>q.push({json.dumps(json.dumps(o))})</script>" for o in objects)


def test_pushed_objects(spark):
    schema = "slug string, size double, note string"
    take = lambda rows: D.pushed_objects(spark.createDataFrame(rows, "page int, html string"), ["page"], "html", r"q\.push", schema, "slug", ["size"])
    got = take([(1, page({"slug": "a", "size": 2.0}, {"slug": "b", "size": 3.0, "note": "é \" x"})), (2, page({"slug": "a", "size": 2.0, "note": "full"})), (3, "<p>none</p>"), (4, None)])
    assert sorted(map(tuple, got.collect())) == [("a", 2.0, "full"), ("b", 3.0, 'é " x')]
    with pytest.raises(Exception, match="core fields differ"):
        take([(1, page({"slug": "a", "size": 2.0}, {"slug": "a", "size": 5.0}))]).collect()


def test_strict_scalars(spark, tmp_path):
    rules = {"name": r"^name: (\S+)$", "score": r"^score: ([\d.]+)$", "item": r"^  - (.*)$", "list": r"^scaffolds:$"}
    good = D.whole_texts(spark, write(tmp_path, a__yaml="name: x\nscore: 1.5\nscaffolds:\n  - one\n  - two\n"))
    assert [(r.name, r.score) for r in D.strict_scalars(good, rules, ["name", "score"]).collect()] == [("x", "1.5")]
    with pytest.raises(Exception, match="not exactly one item"):
        D.strict_scalars(good, rules, ["item"]).collect()
    with pytest.raises(Exception, match="no production"):
        D.strict_scalars(good, {"name": rules["name"]}, ["name"]).collect()


def test_pipe_tables(spark, tmp_path):
    text = "# T\n| Model | A | B |\n|:--|--:|---|\n| Big One | 1 | 2 |\n| short |\n| Small | 3 | |\n"
    rows = D.pipe_tables(D.whole_texts(spark, write(tmp_path, a__md=text)), 3).orderBy("line").collect()
    assert [(r.key, r.cells) for r in rows] == [("bigone", ["Big One", "1", "2"]), ("small", ["Small", "3", ""])]
    with pytest.raises(Exception, match="a label repeats"):
        D.pipe_tables(D.whole_texts(spark, write(tmp_path, a__md=text + "| big one | 5 | 6 |\n")), 3).collect()


def test_declared_digests(spark, tmp_path):
    a, b = "a" * 64, "b" * 64
    body = {"inputs": [{"path": "x.csv", "sha256": a}], "map": {"d/y.csv": b}, "other": {"id": "c" * 64}, "bad": 1}
    leaves = D.deep_leaves(spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None)], "doc int, text string"), ["doc"], "text")
    pairs = D.declared_digests(leaves, ["doc"])
    assert sorted(map(tuple, pairs.collect())) == [(1, "d/y.csv", b), (1, "x.csv", a)]
    found = spark.createDataFrame([("x.csv", a)], "path string, sha256 string")
    assert {r.path: r.status for r in T.verify(pairs, found).collect()} == {"x.csv": "ok", "d/y.csv": "missing"}


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_header_and_mark(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfid,name\n1,x\n2,\n")
    assert sorted(map(tuple, T.read_csv(spark, str(tmp_path), "id int, name string", multi_line).collect())) == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        T.read_csv(spark, str(tmp_path), "id int, other string", multi_line).collect()
