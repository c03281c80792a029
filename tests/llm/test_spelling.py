import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import docs, read
from tidemark.llm.queries import op11_parity_mask_spelling
from tidemark.llm.spelling import BANDS, BAND_BITS, masks, spelling_variants

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def edits(word):
    """Every word that one edit makes, by the contract's words rather than a distance."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    yield from (a + b[1:] for a, b in cuts if b)
    yield from (a + c + b[1:] for a, b in cuts if b for c in LETTERS)
    yield from (a + c + b for a, b in cuts for c in LETTERS)


def plain(rows):
    n = counts(rows)
    near = {w: {v for v in edits(w) if v in n and v != w} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_against_plain_code(spark, small):
    rows = [(r.doc_id, r.text) for r in read(spark, small, "documents").collect()]
    expected = plain(rows)
    assert rows_of(op11_parity_mask_spelling(spark, small)) == expected
    assert any(form for _, form, *_ in expected)


def test_chains_ties_and_accents(spark):
    words = Counter({"harbour": 700, "harbor": 130, "harbur": 20, "hharbur": 4, "lantern": 30, "lanterm": 6, "lanterne": 30, "Lantern": 3, "élévation": 50, "élevation": 6, "àltitude": 40, "Àltitude": 7, "eleven": 60, "elevens": 60, "elevenz": 12, "short": 99, "seldom": 4})
    text = " ".join(itertools.chain.from_iterable([w] * n for w, n in words.items()))
    table = spark.createDataFrame([(i, text, 1) for i in (1, 2)], "doc_id long, text string, mask int")
    got = rows_of(spelling_variants(table))
    assert got == plain([(1, text), (2, text)])
    found = {w: (form, root) for w, form, root, *_ in got}
    assert found["hharbur"] == ("harbur", "harbour")
    assert found["elevenz"] == ("eleven", "eleven")


def test_odd_texts(spark):
    table = docs(spark)
    assert rows_of(spelling_variants(table)) == plain([(r.doc_id, r.text) for r in table.collect()])
    assert rows_of(spelling_variants(table.where("false"))) == set()
    nameless = spark.createDataFrame([(None, "letters " * 9), (None, None), (3, "")], "doc_id long, text string")
    assert rows_of(spelling_variants(nameless)) == plain([(None, "letters " * 9)])


def test_many_words_of_one_key(spark):
    """One common beginning and band: pairs come from the join one by one, and none is lost."""
    words = [f"{'q' * 9}{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(1, " ".join(w for w in words for _ in range(5)))]
    assert rows_of(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(LETTERS, min_size=6, max_size=14), st.data())
def test_one_edit_leaves_a_band(word, data):
    other = data.draw(st.sampled_from(sorted(set(edits(word)))))
    a, b = masks([word, other])
    flipped = int(a ^ b)
    assert flipped.bit_count() <= 2
    assert any(flipped >> (BAND_BITS * k) & ((1 << BAND_BITS) - 1) == 0 for k in range(BANDS))


def test_masks():
    assert masks([]).tolist() == []
    a, b, c = masks(["noon", "no", "aab"])
    assert a == 0 and int(b).bit_count() == 2 and c == masks(["b"])[0] and isinstance(a, np.int64)


@pytest.mark.parametrize("parts", [1, 9])
def test_dealt_otherwise(spark, tiny, parts):
    table = read(spark, tiny, "documents").repartition(parts)
    assert rows_of(spelling_variants(table)) == plain([(r.doc_id, r.text) for r in table.collect()])
