"""Quality rules: distribution divergence from language references.

Each document's character-class histogram and common-word histogram are compared with the
references of its language by the Jensen-Shannon distance. A histogram with too few
observations isn't judged. The references are statistics of all documents:

1. One pass counts the documents of each (language, word); the common words of each language are ranked there.
2. A second pass adds up the character classes and the shares of these words.
3. A third pass gives the verdicts.

Every language of min_language_docs texts has a reference; documents of the others aren't judged by distance. What
is broadcast or collected is bounded: at most 1 / language_share languages of common_words words each. Documents
of further languages meet their words and their reference in a join by language.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch, column, map_arrow, words
from tidemark.session import materialize

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_BLANK = " \t\n\x0b\x0c\r"

CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "accented", "other")
_LOWER, _UPPER, _DIGIT, _BLANKS, _STOP, _SYMBOL, _ACCENTED, _OTHER = range(8)


@dataclass(frozen=True)
class QualityRules:
    """Parameters: how many common words a reference has, which languages and words get one, the share from which a language's is broadcast, and the limits."""

    common_words: int = 64
    word_share: float = 0.02
    language_share: float = 0.001
    min_language_docs: int = 100
    min_chars: int = 200
    min_common: int = 20
    max_class_distance: float = 0.28
    max_word_distance: float = 0.75
    both_class_distance: float = 0.135
    both_word_distance: float = 0.56

    def accepts(self, by_class: float | None, by_word: float | None) -> bool:
        """Neither distance is over its own limit, nor both over the lower limits that hold together."""
        c, w = by_class or 0.0, by_word or 0.0
        alone = c <= self.max_class_distance and w <= self.max_word_distance
        return alone and not (c > self.both_class_distance and w > self.both_word_distance)


@dataclass
class Reference:
    """Of a language, the character-class distribution and the common words with their distribution."""

    classes: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    shares: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """The class of each code point below 0x250; what lies above counts as the last of these, a letter with an accent."""
    out = np.full(0x250, _OTHER, dtype=np.uint8)
    for code in range(0x250):
        char = chr(code)
        if code < 128:
            if char.islower():
                out[code] = _LOWER
            elif char.isupper():
                out[code] = _UPPER
            elif char.isdigit():
                out[code] = _DIGIT
            elif char in _BLANK:
                out[code] = _BLANKS
            elif char in ".,;:'\"-?!()":
                out[code] = _STOP
            else:
                out[code] = _SYMBOL
        elif char.isalpha():
            out[code] = _ACCENTED
    return out


_TABLE = _class_table()


def class_histogram(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.bincount(_TABLE[np.minimum(codes, len(_TABLE) - 1)], minlength=len(CLASSES)).astype(float)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 (equal) to 1 (disjoint). Both are histograms with mass."""
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    total = 0.0
    for x in (p, q):
        held = x > 0
        total += float(np.sum(x[held] * np.log2(x[held] / middle[held])))
    return math.sqrt(max(0.0, total / 2))


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of one text."""
    if not text:
        return 0, 0, 0, 0, 0, []
    found = words(text)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    windows = list(zip(found, found[1:], found[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return (
        len(found),
        sum(map(len, found)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        found,
    )


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _count_words(batches):
    """In each task, by language: the documents that hold each word; the empty word stands for all documents."""
    seen: dict[str, Counter] = defaultdict(Counter)

    def found():
        rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
        seen.clear()
        types = {"lang": pa.string(), "word": pa.string(), "docs": pa.int64()}
        return batch(**{name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(types.items())})

    for part in batches:
        for lang, text in zip(column(part, "lang"), column(part, "text")):
            if text:
                seen[lang].update({w.lower() for w in words(text)})
                seen[lang][""] += 1
        if sum(map(len, seen.values())) > 400_000:
            yield found()
    yield found()


#: A document's share of a reference is a whole number of parts of this many, so that sums are the same in any order.
PARTS = 1 << 24


def _sum_shares(batches, wanted_of):
    """In each task, by language: the sums of the class shares and of the common words' shares of each document, in parts."""
    classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), dtype=np.int64))
    shares: dict[str, Counter] = defaultdict(Counter)

    def found():
        rows = [(k, "class", CLASSES[i], int(v)) for k, h in classes.items() for i, v in enumerate(h)]
        rows += [(k, "word", w, x) for k, c in shares.items() for w, x in c.items()]
        classes.clear(), shares.clear()
        types = {"lang": pa.string(), "kind": pa.string(), "item": pa.string(), "share": pa.int64()}
        return batch(**{name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(types.items())})

    for part in batches:
        for lang, text, wanted in zip(column(part, "lang"), column(part, "text"), wanted_of(part)):
            if not text or wanted is None:
                continue
            histogram = class_histogram(text)
            classes[lang] += np.rint(histogram / histogram.sum() * PARTS).astype(np.int64)
            counts = Counter(w for w in map(str.lower, words(text)) if w in wanted)
            total = sum(counts.values())
            for word, n in counts.items():
                shares[lang][word] += round(n / total * PARTS)
        if len(classes) > 4_000:
            yield found()
    yield found()


def _read_words(known: str) -> frozenset:
    return frozenset(json.loads(known))


def _read_reference(known: str) -> Reference:
    rows = json.loads(known)
    by = {(r["kind"], r["item"]): r["share"] for r in rows}
    top = sorted(r["item"] for r in rows if r["kind"] == "word")
    shares = np.array([by["word", w] for w in top], dtype=float)
    return Reference(np.array([by["class", c] for c in CLASSES], dtype=float), {w: i for i, w in enumerate(top)}, shares)


@dataclass
class Known:
    """What is known of languages: collected for the common ones, a table of (lang, known) for the rest, if there are any."""

    common: dict[str, str]
    rest: DataFrame | None

    @staticmethod
    def of(table: DataFrame, common: list[str]) -> Known:
        """Of a table (lang, known) that is at rest; only the rows of common languages are collected."""
        rest = table.where(~F.col("lang").isin(common))
        return Known({r.lang: r.known for r in table.where(F.col("lang").isin(common)).collect()}, None if rest.isEmpty() else rest)

    def map(self, docs: DataFrame, run, read, schema: str) -> DataFrame:
        """run(batches, function from a batch to what is known of each row's language or None) over all docs."""
        fixed = {k: read(v) for k, v in self.common.items()}

        def of_common(batches):
            return run(batches, lambda part: [fixed.get(k) for k in column(part, "lang")])

        if self.rest is None:
            return map_arrow(docs, of_common, schema)

        def of_rest(batches):
            last: list = [None, None]

            def known(part):
                for text in column(part, "known"):
                    if text is not None and text != last[0]:
                        last[:] = text, read(text)
                    yield None if text is None else last[1]

            return run(batches, known)

        here = F.col("lang").isin(list(self.common))
        joined = docs.where(~here).join(self.rest, "lang", "left")
        return map_arrow(docs.where(here), of_common, schema).unionByName(map_arrow(joined, of_rest, schema))


def references(docs: DataFrame, rules: QualityRules = QualityRules()) -> Known:
    """Language references over all documents (lang not null)."""
    texts = docs.select("lang", "text")
    counted = map_arrow(texts, _count_words, "lang string, word string, docs long").groupBy("lang", "word").agg(F.sum("docs").alias("docs"))
    # The empty word, in all documents of a language, comes first; Spark limits each language before it deals out.
    rank = Window.partitionBy("lang").orderBy(F.desc("docs"), F.asc("word"))
    ranked = counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= rules.common_words + 1)
    by_lang = ranked.groupBy("lang").agg(F.max("docs").alias("docs"), F.collect_list(F.struct("word", F.col("docs").alias("n"))).alias("top"))
    wanted = F.expr(f"transform(filter(top, x -> x.word != '' and x.n >= {rules.word_share} * docs), x -> x.word)")
    languages = materialize(by_lang.select("lang", "docs", F.to_json(wanted).alias("known")))
    total = languages.agg(F.sum("docs")).first()[0] or 0
    enough = languages.where(F.col("docs") >= rules.min_language_docs)
    common = [r.lang for r in enough.where(F.col("docs") >= rules.language_share * total).select("lang").collect()]
    top = Known.of(enough.select("lang", "known"), common)
    sums = top.map(texts, _sum_shares, _read_words, "lang string, kind string, item string, share long").groupBy("lang", "kind", "item").agg(F.sum("share").alias("share"))
    known = sums.groupBy("lang").agg(F.to_json(F.collect_list(F.struct("kind", "item", "share"))).alias("known"))
    return Known.of(materialize(known), common)


def distances(text: str, found: list[str], known: Reference | None, rules: QualityRules) -> tuple[float | None, float | None]:
    """Class and word distance to the language's reference; None where a guard holds or the language has none."""
    by_class = by_word = None
    if known is None:
        return by_class, by_word
    if len(text) >= rules.min_chars:
        by_class = js_distance(class_histogram(text), known.classes)
    at = [known.words[w] for w in map(str.lower, found) if w in known.words]
    if at and len(at) >= rules.min_common:
        by_word = js_distance(np.bincount(at, minlength=len(known.words)).astype(float), known.shares)
    return by_class, by_word


def _judge(rules: QualityRules):
    def run(batches, known_of):
        for part in batches:
            rows = []
            for doc_id, text, known in zip(column(part, "doc_id"), column(part, "text"), known_of(part)):
                *counts, found = base_counts(text)
                failed = base_fails(counts[0], counts[4])
                by_class, by_word = distances(text or "", found, known, rules)
                rows.append((doc_id, *counts, failed, not failed and rules.accepts(by_class, by_word), by_class, by_word))
            names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield batch(**{n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})

    return run


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): base counts, base_failed, kept and both distances.

    A null or empty text has no words, so its base fails; a null language is the same as an empty one. Repeated rows
    and ids are judged one by one; other columns are ignored; an empty table gives an empty result. Texts of any
    length are judged whole.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, class_distance double, word_distance double"
    )
    return references(texts, rules).map(texts, _judge(rules), _read_reference, schema)
