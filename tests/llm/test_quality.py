import math
import re

from tests.llm.helpers import ODD_TEXTS, docs, read
from tidemark.llm.quality import CLASSES, QualityRules, class_histogram, js_distance, quality

import numpy as np
import pytest


def base(text):
    """The contract's counts, word for word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    held = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(held) - len(set(held)), len(inside), failed


def rows_of(df):
    return sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())


def test_base_counts_match_brute_force(spark, tiny):
    for table in (docs(spark), read(spark, tiny, "documents")):
        expected = sorted((r.doc_id, *base(r.text)) for r in table.select("doc_id", "text").collect())
        assert rows_of(quality(table)) == expected


def test_kept_follows_base_and_good_documents_stay(spark, small):
    got = quality(read(spark, small, "documents")).join(read(spark, small, "labels"), "doc_id").collect()
    assert not any(r.kept for r in got if r.base_failed)
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.5 * len(bad)


def test_empty_table(spark):
    assert quality(docs(spark, [])).count() == 0


def test_distance_and_histogram():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 3.0])
    assert js_distance(p, q) == pytest.approx(1.0) and js_distance(p, p) == 0
    m = np.array([0.75, 0.25])
    expected = math.sqrt(0.5 * (math.log2(1 / 0.75) + 0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25)))
    assert js_distance(p, np.array([1.0, 1.0])) == pytest.approx(expected) and m.sum() == 1
    assert dict(zip(CLASSES, class_histogram("aB1 .#é日×"))) == {"lower": 1, "upper": 1, "digit": 1, "blank": 1, "stop": 1, "symbol": 1, "accented": 2, "other": 1}


def _texts(lang, letters, n, first):
    rng = np.random.default_rng(first)
    vocabulary = ["".join(rng.choice(list(letters), 4)) for _ in range(60)]
    return [(first + i, lang, " ".join(rng.choice(vocabulary, 90))) for i in range(n)]


def test_languages_of_a_small_share_have_their_own_reference(spark):
    """A script of its own is judged by its own language, be it collected or joined; one of too few texts isn't judged."""
    from tidemark.llm.quality import QualityRules

    rows = _texts("en", "abcdefghijklmnop", 300, 0) + _texts("el", "αβγδεζηθικλμν", 120, 1000) + _texts("ru", "абвгдежзиклмн", 110, 2000) + _texts("zh", "日本語中文字", 3, 3000)
    rows += [(4000, "el", " ".join(["abcd efgh"] * 2 + [f"w{i}x" for i in range(150)]))]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    read = lambda share: sorted((r.doc_id, r.kept, r.class_distance, r.word_distance) for r in quality(table, QualityRules(language_share=share)).collect())
    collected, joined = read(0.001), read(0.5)
    assert [x[:2] for x in collected] == [x[:2] for x in joined]
    assert len(joined) == len(rows) and all(kept for doc_id, kept, *_ in joined if doc_id < 4000)
    assert joined[-1][:2] == (4000, False) and joined[-1][2] > 0.28
    assert all(by_class is None and by_word is None for doc_id, _, by_class, by_word in joined if 3000 <= doc_id < 4000)
    assert all(a[2] == pytest.approx(b[2]) for a, b in zip(collected, joined) if a[2] is not None)


def test_what_reaches_the_driver_is_bounded(spark):
    """Partitions of few documents, each with words of its own: only the common words of a language are collected."""
    import json

    from tidemark.llm.quality import QualityRules, references

    rows = [("en", " ".join([f"all{k}" for k in range(30)] + [f"w{i}x{k}" for k in range(200)])) for i in range(120)]
    known = references(spark.createDataFrame(rows, "lang string, text string").repartition(24), QualityRules())
    found = {x["item"] for x in json.loads(known.common["en"]) if x["kind"] == "word"}
    assert known.rest is None and found == {f"all{k}" for k in range(30)}


def test_partitions_change_nothing(spark, tiny):
    table = read(spark, tiny, "documents")
    first, *others = (sorted(map(tuple, quality(table.repartition(n)).collect())) for n in (1, 8, 64))
    assert all(o == first for o in others)


def plain_quality(rows, rules):
    """References, distances and verdicts in plain Python over all rows of (doc_id, text, lang)."""
    blank = re.compile(r"[^\x20\x09-\x0D]+")
    by_lang = {}
    for _, text, lang in rows:
        if text:
            by_lang.setdefault(lang or "", []).append(text)
    known = {}
    for lang, texts in by_lang.items():
        if len(texts) < rules.min_language_docs:
            continue
        holds = {}
        for text in texts:
            for w in {w.lower() for w in blank.findall(text)}:
                holds[w] = holds.get(w, 0) + 1
        top = [w for w in sorted(holds, key=lambda w: (-holds[w], w))[: rules.common_words] if holds[w] >= rules.word_share * len(texts)]
        classes, shares = [0.0] * len(CLASSES), dict.fromkeys(top, 0.0)
        for text in texts:
            histogram = class_histogram(text)
            classes = [a + b / sum(histogram) for a, b in zip(classes, histogram)]
            found = [w for w in (w.lower() for w in blank.findall(text)) if w in shares]
            for w in found:
                shares[w] += 1 / len(found)
        known[lang] = classes, shares
    out = {}
    for i, text, lang in rows:
        classes, shares = known.get(lang or "", (None, None))
        by_class = by_word = None
        if classes and text and len(text) >= rules.min_chars:
            by_class = divergence(list(class_histogram(text)), classes)
        if shares:
            found = [w for w in (w.lower() for w in blank.findall(text or "")) if w in shares]
            if found and len(found) >= rules.min_common:
                by_word = divergence([found.count(w) for w in shares], list(shares.values()))
        out[i] = (not base(text)[5] and rules.accepts(by_class, by_word), by_class, by_word)
    return out


def divergence(a, b):
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    part = lambda u: sum(x * math.log2(2 * x / (x + y)) for x, y in u if x > 0)
    return math.sqrt(max(0.0, (part(zip(p, q)) + part(zip(q, p))) / 2))


def test_distances_and_verdicts_match_plain_code(spark, small):
    rules = QualityRules(min_language_docs=20)
    table = read(spark, small, "documents").where("doc_id < 400")
    wanted = plain_quality([(r.doc_id, r.text, r.lang) for r in table.collect()], rules)
    compared = 0
    for r in quality(table, rules).collect():
        kept, by_class, by_word = wanted[r.doc_id]
        assert (r.class_distance is None) == (by_class is None) and (r.word_distance is None) == (by_word is None)
        for a, b in ((r.class_distance, by_class), (r.word_distance, by_word)):
            if b is not None:
                assert a == pytest.approx(b, abs=1e-5)
                compared += 1
        assert r.kept == kept
    assert compared > 400
