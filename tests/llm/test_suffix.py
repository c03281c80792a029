import random
from collections import Counter

import numpy as np

from tests.llm.helpers import docs, read
from tidemark.llm.suffix import MATCH, SuffixRules, deep_shallow_order, remove_repeats, window_digests


def brute(rows):
    """By row: bytes, bytes removed, runs and what is left, from a dictionary of all 50-byte strings."""
    least = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - MATCH + 1):
            least.setdefault(raw[p : p + MATCH], i)
    out = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - MATCH + 1):
            if least[raw[p : p + MATCH]] < i:
                gone[p : p + MATCH] = [True] * MATCH
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)] += 1
    return out


def got(df, **rules):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, SuffixRules(**rules)).collect())


def test_same_as_brute_force(spark, tiny):
    for table in (docs(spark), read(spark, tiny, "documents")):
        assert got(table) == brute([tuple(r) for r in table.select("doc_id", "text").collect()])


def test_overlapping_repeats(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool)[rng.randint(0, 10) :] for _ in range(rng.randint(0, 7)))) for k in range(80)]
    rows += [(100, "z" * 400), (101, "z" * 49), (102, "z" * 50), (103, "q" + "z" * 120 + "q")]
    assert got(docs(spark, rows)) == brute(rows)
    assert got(docs(spark, rows), hot_anchor=3) == brute(rows)


def test_hot_anchors_part_by_window(spark, tiny):
    """One line among differing surroundings in most documents, with all anchors, many or the common ones dealt by window."""
    rng = random.Random(9)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = "All rights are reserved by whoever wrote this text."
    rows = [(k, words(rng.randint(0, 80)) + (line if k % 4 else words(40)) + words(rng.randint(0, 80))) for k in range(120)]
    rows += [(5, rows[5][1]), (121, line * 3), (122, line[:50]), (None, line), (123, None)]
    whole = brute([(-1 if i is None else i, t) for i, t in rows])
    for hot in (0, 20, 100):
        found = got(docs(spark, rows), hot_anchor=hot)
        assert Counter({(-1 if k[0] is None else k[0], *k[1:]): n for k, n in found.items()}) == whole
    table = read(spark, tiny, "documents")
    assert got(table, hot_anchor=5, hot_copies=2) == brute([tuple(r) for r in table.select("doc_id", "text").collect()])


def test_window_digests_tell_all_bytes():
    raw = np.zeros((MATCH + 1, MATCH), dtype=np.uint8)
    raw[np.arange(MATCH), np.arange(MATCH)] = 1
    a, b = window_digests(raw.reshape(-1), np.arange(MATCH + 1) * MATCH)
    assert len(set(a.tolist())) == len(set(b.tolist())) == MATCH + 1


def test_text_form_carries_columns(spark):
    table = docs(spark, [(1, "é" * 40), (2, "x" + "é" * 40)])
    out = {r.doc_id: r for r in remove_repeats(table, as_text=True, carry=("lang", "bucket")).collect()}
    assert out[1].kept == "é" * 40 and out[2].kept == "x" and out[2].bucket == "b"


def test_deep_shallow_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (3000, 50)).astype(np.uint8)
    rows[:2000, :30] = rows[0, :30]
    order = deep_shallow_order(rows)
    assert [bytes(rows[k]) for k in order] == sorted(map(bytes, rows))


def test_empty_table(spark):
    assert remove_repeats(docs(spark, [])).count() == 0
