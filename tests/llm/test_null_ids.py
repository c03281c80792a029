"""Rows without an id, repeated ids and null texts go through every operator on documents with a defined result."""

import pytest

import corpus_pipeline
from tests.llm.helpers import PASSAGE
from tidemark.llm.bpe import encode_decode
from tidemark.llm.gru import language_scores
from tidemark.llm.quality import quality
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.suffix import remove_repeats
from tidemark.llm.tokenbin import packed_rows

LONG = " ".join(f"word{i}" for i in range(80))
ROWS = [(None, f"{PASSAGE} and more of it"), (None, f"{PASSAGE} and more of it"), (None, None), (4, f"{PASSAGE} ends here"), (4, f"{PASSAGE} ends here"), (5, None), (6, LONG), (None, LONG)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.collect())


def test_every_row_comes_back(table):
    wanted = sorted((i is not None, i or 0) for i, _ in ROWS)
    for made in (quality(table), encode_decode(table, "word_bpe_49k.json"), language_scores(table), near_duplicates(table), remove_repeats(table)):
        assert ids(made) == wanted
    assert sum(len(r.doc_ids) for r in packed_rows(table, "word_bpe_49k.json").collect()) == len(ROWS)


def test_held_out_and_components(table):
    assert {(r.doc_id, r.held_out) for r in language_scores(table).collect() if r.doc_id is None} == {(None, True)}
    named = {(r.doc_id, r.component_id) for r in near_duplicates(table).collect()}
    assert named == {(None, None), (4, 4), (5, 5), (6, 6), (None, 5), (None, 6)}


def test_null_id_is_the_smallest_in_suffix_dedup(table):
    got = sorted(((r.doc_id or 0), r.n_removed > 0) for r in remove_repeats(table).collect())
    assert got == [(0, False)] * 4 + [(4, True), (4, True), (5, False), (6, True)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_null_ids(spark, tiny, table, name):
    made = dict(corpus_pipeline.STAGES)[name](spark, table, tiny)
    assert made.count() >= 1
    if name != "best-fit packing":
        assert made.columns == table.columns
