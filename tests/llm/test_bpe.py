import hashlib

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import docs, read
from tidemark.llm.bpe import BytePairCoder, encode_decode

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(public_tokenizers.path(NAME))
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def own():
    return BytePairCoder(public_tokenizers.path(NAME))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_same_as_the_library(spark, tiny, library):
    for table in (docs(spark), read(spark, tiny, "documents")):
        expected = []
        for r in table.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            expected.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
        assert sorted(map(tuple, encode_decode(table, NAME).collect())) == sorted(expected)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab'sS .,!?<|>endoftxŕΣσ \x1c\x85123", max_size=40))
@example("0¼")
@example(":\U0003d000")
@example("a\U0003d000b, \U000e0001x")
def test_any_text(own, library, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_fragments_are_cut_only_where_no_token_joins(own):
    for word in ("strengths", "zqxjk", "Ã©Ł¥"):
        cuts = own.fragments(word)
        assert "".join(cuts) == word
        assert all(a[-1] + b[0] not in own._joined for a, b in zip(cuts, cuts[1:]))


def test_empty_table(spark):
    assert encode_decode(docs(spark, []), NAME).count() == 0
