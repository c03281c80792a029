"""Grouping of spelling variants by bands of letter-parity masks.

A word's mask has one bit for each letter, set if the letter occurs an odd number of times. One inserted, deleted or
replaced letter flips at most two bits, so of the three bands of the mask at least one is equal for two near words. Words
join on an equal band, on the length of the shorter of the two, and on the half of the word (before or after its middle)
that the edit leaves alone; then the masks are compared as wholes, and what is left is verified letter by letter.

Occurrences are counted by Spark: tasks add up what they read in bounded tables before the shuffle. The join's rows are
words that are frequent enough, not occurrences.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, batch, column, map_arrow
from tidemark.session import discard, materialize

#: Fixed values of the contract.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP_EVERY = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
DOMINANCE = 5
#: The mask's three bands of 21 bits. Letters are dealt to them by how common they are in Latin texts, so that none is idle.
BAND_BITS = 21
BANDS = 3
COMMON = "etaoinsrhldcumfpgwybvkxjqzéèàêçùâîôûëïüöäßñáíóú"
#: Distinct words that a task holds before it hands them on.
HELD = 200_000


def letter_bits() -> dict[str, int]:
    """The mask's bit of each letter: letters by frequency go to the bands in turn; beyond 63 letters bits are shared."""
    every = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
    ordered = [*COMMON, *(c for c in every if c not in COMMON)]
    return {c: (k % BANDS) * BAND_BITS + (k // BANDS) % BAND_BITS for k, c in enumerate(ordered)}


def masks(words: list[str]) -> np.ndarray:
    """Letter-parity masks of words, as longs."""
    bits = letter_bits()
    table = np.zeros(0x100, dtype=np.int64)
    for letter, bit in bits.items():
        table[ord(letter)] = 1 << bit
    codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
    return np.bitwise_xor.reduceat(table[codes], starts) if len(words) else np.zeros(0, np.int64)


def edited_words(doc_id: int | None, text: str | None) -> dict[str, int]:
    """The words of one text with their occurrences, after the contract's deletions; a null id counts as an empty one."""
    found: dict[str, int] = {}
    for run in RUN.findall(text) if text else ():
        found[run] = found.get(run, 0) + 1
    out: dict[str, int] = {}
    start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    for run, n in found.items():
        word = run.lower() if run.isascii() else run.translate(ASCII_LOWER)
        h = zlib.crc32(word.encode(), start)
        if h % DROP_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= LEAST_LENGTH:
            out[word] = out.get(word, 0) + n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n and mask of the words of `docs` (doc_id, text) that are long and frequent enough."""

    def hand_on(held):
        return batch(word=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))

    def count(batches):
        held: dict[str, int] = {}
        for part in batches:
            for doc_id, text in zip(column(part, "doc_id"), part.column(part.schema.get_field_index("text"))):
                for word, n in edited_words(doc_id, text.as_py()).items():
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield hand_on(held)
                    held = {}
        if held:
            yield hand_on(held)

    def mark(batches):
        for part in batches:
            yield batch(word=part.column(0), n=part.column(1), mask=pa.array(masks(column(part, "word"))))

    counted = map_arrow(docs.select("doc_id", "text"), count, "word string, n long")
    frequent = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return map_arrow(frequent, mark, "word string, n long, mask long")


def _band(mask: Column, k: int) -> Column:
    return F.shiftright(mask, BAND_BITS * k).bitwiseAND((1 << BAND_BITS) - 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words (word, n, mask) that one inserted, deleted or replaced letter tells apart, each once.

    Every word is offered for pairs of its own length (as either word) and of one letter more (as the shorter) or less (as
    the longer), with each band and each half of the shorter word: the first letters of both, or the last letters of both.
    A pair meets on up to six keys; only its first one, in the order of bands and then halves, lets it through.
    """
    length = F.length("word")
    sides = []
    for longer in (False, True):
        short = length - 1 if longer else length
        before = F.floor(short / 2).cast("int")
        heads, tails = F.substring("word", F.lit(1), before), F.right("word", (short - before).cast("int"))
        keys = [F.struct(F.lit(2 * k + after).alias("kind"), _band(F.col("mask"), k).alias("band"), half.alias("half")) for k in range(BANDS) for after, half in enumerate((heads, tails))]
        sides.append(words.select("word", "n", "mask", short.alias("short"), heads.alias("heads"), F.explode(F.array(*keys)).alias("key")).select("*", "key.*").drop("key"))
    own, longer = sides
    right = own.unionByName(longer).select(*[F.col(c).alias(f"b_{c}") for c in own.columns])
    left = own.select(*[F.col(c).alias(f"a_{c}") for c in own.columns])
    key = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("kind", "short", "band", "half")]
    flipped = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    once = (F.length("b_word") > F.length("a_word")) | (F.col("a_word") < F.col("b_word"))
    here = F.floor(F.col("a_kind") / 2)
    first = (F.col("a_kind") % 2 == 0) | (F.col("a_heads") != F.col("b_heads"))
    earlier = [(here <= k) | (_band(flipped, k) != 0) for k in range(BANDS - 1)]
    verified = F.levenshtein("a_word", "b_word", 1) == 1
    condition = once & (F.bit_count(flipped) <= 2) & first
    for e in earlier:
        condition = condition & e
    joined = left.join(right, [*key, condition & verified])
    return joined.select(F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every row of `forms` (word, form), following forms to the last; by pointer jumping over written tables.

    Counts grow at least DOMINANCE times with each step, so chains are short and the turns few.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        turned = materialize(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(now)
        now = turned.drop("moved")
        now._tidemark_path = turned._tidemark_path
        if not turned.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the words of `docs` (doc_id, text).

    Texts that are null, empty or without runs of letters give no words; a null id counts as an empty one; repeated rows count
    again; other columns are ignored; an empty table gives an empty result. Forms are chosen by n, ties by code point.
    """
    words = materialize(vocabulary(docs))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")))
    near = materialize(both.groupBy("a", "a_n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")))
    chosen = -F.col("best.less") >= DOMINANCE * F.col("a_n")
    near = near.select(F.col("a").alias("word"), "n_near", F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    found = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
