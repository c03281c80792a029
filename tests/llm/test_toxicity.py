import math
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import docs, read
from tidemark.llm.toxicity import automaton, features, fit, fold, phrases, toxicity


def test_held_out_accuracy(spark, small):
    labels = read(spark, small, "labels")
    got = toxicity(read(spark, small, "documents"), labels)
    assert got.count() == 1000
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = got.collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(p == t for p, t in judged) >= 0.93 * len(judged)
    toxic = [p for p, t in judged if t == 1]
    assert sum(toxic) >= 0.75 * len(toxic)


def test_odd_texts_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs(spark), labels).collect()}
    assert got[14].predicted == 1 and not any(got[i].predicted for i in (1, 3, 4, 5, 6, 7, 9))


def test_empty_tables(spark):
    assert toxicity(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("Ｉd1ОT, $tupid!", " idiot stupid "),
        ("@sshole a$$ as$ !diot n@sty", " asshole ass ass idiot nasty "),
        ("stupid! |stupid| stupid!! wow!", " stupid stupid stupid wow "),
        ("455 4.55 $455 4$5 year 1984, 5tup1d 4ss", " 455 4 55 455 4 5 year 1984 stupid ass "),
        ("a | b |c| || !! @ $", " a b c "),
        ("tail\u200bed s\u0301tupid _455_ x_1", " tailed stupid 455 x 1 "),
        (None, " "),
    ],
)
def test_folding(text, folded):
    assert fold(text) == folded


def plain_total(lexicon, harmless, folded):
    """The weight of every entry at every place, and that of entries inside a harmless phrase taken back at every place of it."""
    places = lambda entry, text: sum(text.startswith(entry, k) for k in range(len(text)))
    inside = {p: sum(w * places(e, f" {p} ") for e, w in lexicon.items()) for p in harmless}
    return max(0.0, sum(w * places(e, folded) for e, w in lexicon.items()) - sum(w * places(f" {p} ", folded) for p, w in inside.items()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("trash trashy can tra $tra5h 45 sh ash can! the".split()), max_size=12))
def test_matching_against_every_place(words):
    lexicon, harmless = {" trash ": 2.0, " tra": 0.5, " can ": 0.25, " ash": 1.5}, ("trash can", "the ash", "can can")
    text = " ".join(words)
    total = plain_total(lexicon, harmless, fold(text))
    a, b = features(automaton(lexicon, harmless), text)
    assert a == pytest.approx(math.log1p(total)) and b == pytest.approx(math.log1p(100 * total / max(1, len(fold(text).split()))))


def test_phrases_of_exception_take_weight_back():
    matcher = automaton({" trash ": 2.0})
    assert features(matcher, "what trash")[0] > 0 and features(matcher, "the trash can")[0] == 0


def test_phrases_of_exception_are_learned(spark):
    assert phrases(automaton({" snark ": 1.0, " gruf": 1.0}), fold("a snark hunt was gruffly told")) == {"a snark", "snark hunt", "was gruffly", "gruffly told"}
    bad = [(i, f"you {'utter ' * (i % 2)}snark of a man number {i}", 1) for i in range(200)]
    good = [(1000 + i, f"the snark hunt of year {i} went well" if i < 8 else f"plain words of year {i}", 0) for i in range(800)]
    rows = bad + good
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = fit(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), labels)
    assert "snark hunt" in model.harmless and "you snark" not in model.harmless
    score = model.scorer()
    assert score("you snark of a man") >= 0.7 > score("another snark hunt began")


def test_null_ids_are_scored_and_not_held_out(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(spark.createDataFrame([(None, "fine words"), (None, "you idiot")], "doc_id long, text string"), labels).collect()
    assert sorted((r.held_out, r.predicted) for r in got) == [(False, 0), (False, 1)]
