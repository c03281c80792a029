import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import docs, read
from tidemark.llm.gru import Counts, GruRules, Lexicon, Trainer, initial, language_scores, score_documents


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def check_base(spark, table):
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) + [None]) for r in table.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, words in rows if not held(i) for w in words)
    total, distinct = sum(counts.values()), len(counts)
    got = language_scores(table).collect()
    expected = sorted((i, held(i), len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)) for i, w in rows)
    for a, b in zip(sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), expected, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


def test_counts_match_brute_force_and_the_model_beats_them_on_held_out_documents(spark, small):
    got = check_base(spark, read(spark, small, "documents"))
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > 0.96 * sum(r.base_score for r in held)  # scores are negative


def test_odd_texts(spark):
    check_base(spark, docs(spark))


def test_empty_table(spark):
    assert language_scores(docs(spark, [])).count() == 0


def test_slices_are_read_whole():
    texts = pa.array(["é", "First", None, "a B\tb", "Ünder ÜNDER"])
    words = Lexicon(4)
    read = [words.read(texts.slice(k, 2)) for k in (0, 2, 4)]
    spelled = list(words.numbers)
    assert [spelled[i].decode() for ids, _ in read for i in ids] == ["é", "", "first", "", "", "a", "b", "b", "", "Ünder", "Ünder", ""]
    assert [n for _, sizes in read for n in sizes] == [2, 2, 1, 4, 3]


def test_gradients_match_differences():
    """The window's gradients against numerical ones of the plain log likelihood, lanes of unlike length and a lead included."""
    rules = GruRules(words=8, class_words=4, tail_classes=2, hidden=3, window=4, lanes=8, segment=6, rate=1.0)
    counts = Counts(40, 8, np.arange(8, dtype=np.uint64), np.arange(8, 0, -1).astype(float), np.array([2, 2]), np.array([1, 1]))
    start = {k: v.astype(np.float64) + 0.05 for k, v in initial(counts, rules).items()}
    docs = [np.array([1, 4, 9, 0], dtype=np.int32), np.array([5, 0], dtype=np.int32)]

    class Kept(Trainer):
        def _move(self, name, gradient, rows=slice(None)):
            found.setdefault(name, np.zeros_like(start[name]))[rows] += gradient

    found = {}
    Kept(start, rules).learn(docs, 0)
    loss = lambda p: -score_documents(p, docs, 0, rules).sum() / (6 / 4)
    rng = np.random.default_rng(1)
    for name, value in start.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            moved = {k: v.copy() for k, v in start.items()}
            moved[name][at] += 1e-2
            up = loss(moved)
            moved[name][at] -= 2e-2
            assert found.get(name, np.zeros_like(value))[at] == pytest.approx((up - loss(moved)) / 2e-2, rel=2e-2, abs=2e-3)


def plain_score(p, doc, end, rules):
    """The log likelihood of one document, token by token, from the formulas of a gated unit and two softmaxes."""
    size, h, before, total = rules.hidden, [0.0] * rules.hidden, end, 0.0
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for token in doc:
        x = p["input"][before].tolist()
        a = [sum(h[i] * p["state"][i, j] for i in range(size)) for j in range(3 * size)]
        z = [sigmoid(x[j] + a[j]) for j in range(size)]
        r = [sigmoid(x[size + j] + a[size + j]) for j in range(size)]
        n = [math.tanh(x[2 * size + j] + r[j] * a[2 * size + j]) for j in range(size)]
        h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(size)]
        known = token < rules.words
        cls = token // rules.class_words if known else rules.word_classes + token - rules.words
        logits = [sum(h[i] * p["class"][i, k] for i in range(size)) + p["class_bias"][k] for k in range(len(p["class_bias"]))]
        total += logits[cls] - math.log(sum(map(math.exp, logits)))
        if known:
            inner = [sum(h[i] * p["word"][cls][i, k] for i in range(size)) + p["word_bias"][cls][k] for k in range(rules.class_words)]
            total += inner[token % rules.class_words] - math.log(sum(map(math.exp, inner)))
        before = token
    return total


def test_scores_match_plain_code_and_probabilities_add_up():
    rules = GruRules(words=8, class_words=4, tail_classes=2, hidden=3)
    counts = Counts(40, 8, np.arange(8, dtype=np.uint64), np.arange(8, 0, -1).astype(float), np.array([2, 2]), np.array([1, 1]))
    p = {k: 3 * v.astype(np.float64) + 0.1 for k, v in initial(counts, rules).items()}
    docs = [np.array(d, dtype=np.int32) for d in ([1, 4, 9, 0], [5, 0], [0], [8, 2, 2, 7, 3, 6, 0])]
    for lanes in (1, 2, 512):  # documents that follow another in its lane, too
        for got, doc in zip(score_documents(p, docs, 0, rules, lanes), docs):
            assert got == pytest.approx(plain_score(p, doc.tolist(), 0, rules), rel=1e-9)
    ends = [np.array([3, t], dtype=np.int32) for t in range(10)]
    first = score_documents(p, [np.array([3], dtype=np.int32)], 0, rules)[0]
    assert np.exp(score_documents(p, ends, 0, rules) - first).sum() == pytest.approx(1.0)


def test_scores_of_several_blocks_match_plain_code():
    rules = GruRules(words=8, class_words=4, tail_classes=2, hidden=3)
    counts = Counts(40, 8, np.arange(8, dtype=np.uint64), np.arange(8, 0, -1).astype(float), np.array([2, 2]), np.array([1, 1]))
    p = {k: 3 * v.astype(np.float64) + 0.1 for k, v in initial(counts, rules).items()}
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(1, 10, n), 0).astype(np.int32) for n in (70, 33, 1, 20, 5, 40)]
    for lanes in (1, 2, 3):  # blocks end inside documents, and lanes end inside blocks
        assert score_documents(p, docs, 0, rules, lanes) == pytest.approx([plain_score(p, d.tolist(), 0, rules) for d in docs], rel=1e-9)


def test_windows_after_the_first_keep_their_arrays():
    """What a window of many lanes takes afresh is small; its arrays of all tokens and features stay from the first one."""
    rules = GruRules(segment=32, lanes=64)
    counts = Counts(2000, 1024, np.arange(1024, dtype=np.uint64), np.ones(1024), np.ones(32, dtype=np.int64), np.ones(32, dtype=np.int64))
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 1056, 32).astype(np.int32) for _ in range(512)]
    trainer = Trainer(initial(counts, rules), rules)
    trainer.learn(docs, 0)
    tracemalloc.start()
    try:
        trainer.learn(docs, 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert trainer.updates > 2 and peak < 2_000_000
