"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded texts.

Folding lower-cases, replaces look-alike letters and digits by Latin letters, strips accents and puts one space
between words. A lexicon entry is a whole word or the start of words; its weight is a smoothed log odds ratio
of documents, learned from labelled rows alone. Phrases in which an entry is harmless cancel its weight: a few fixed ones, and
those of two words that clean documents use and toxic ones don't. The total weight, alone and by length, becomes a score with
a logistic curve that is fitted to documents whose fold the lexicon hadn't seen. A short list of known insults serves only
where there are no labels of both kinds to learn from.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, column, map_arrow
from tidemark.session import discard, materialize

#: Insults for tables without labels, and phrases in which such a word is harmless.
INSULTS = tuple("idiot moron stupid scum loser clown trash pathetic disgusting worthless imbecile dumbass bastard asshole retard scumbag".split())
HARMLESS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "circus clown", "sore loser", "trash collection")
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕһԁɡքոսαορτνικβεηυχ", "aeopcyxijshdgpnuaoptvikbehux"))
DIGITS = dict(zip("01345789", "oieastbg"))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}

#: A run of letters, digits and signs, and a number that stands alone; digits of such are kept aside.
_SIGNED = re.compile(r"[^\W_]*[@$!|](?:[^\W_]|[@$!|])*")
_NUMBER = re.compile(r"(?<![^\W_])[0-9]+(?![^\W_])")
_ASIDE = {ord("0") + d: chr(0xE000 + d) for d in range(10)}
_SIGN_TABLE = str.maketrans(SIGNS)
HELD = 300_000


@dataclass(frozen=True)
class ToxicityRules:
    """Bounds and smoothing. At most max_labelled labelled rows are used to fit; what they hold bounds the lexicon and its phrases."""

    max_labelled: int = 20_000
    prefix_lengths: tuple[int, ...] = (4, 5, 6, 7, 8)
    min_documents: int = 3
    prior: float = 0.1
    min_weight: float = 2.5
    min_evidence: float = 16.0
    threshold: float = 0.7


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()}
    for code in range(0x250):
        char = chr(code)
        if code < 128:
            if not char.isalnum():
                table[code] = " "
        else:
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
            table[code] = plain if plain.isalpha() else (char.lower() if char.isalpha() else " ")
    for code in range(0xFF21, 0xFF5B):
        table[code] = unicodedata.normalize("NFKC", chr(code)).lower()
    for code in (0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF, *range(0x300, 0x370)):
        table[code] = ""
    for kept in _ASIDE.values():
        table[ord(kept)] = chr(ord(kept) - 0xE000 + ord("0"))
    return table


_FOLD = _fold_table()


def _unsigned(found: re.Match) -> str:
    """Signs of a word as letters; those that may close or frame it (! and |) stay signs at its end, | at its start too."""
    word = found[0]
    body = word.rstrip("!|")
    start = len(body) - len(body.lstrip("|"))
    if not any(c.isalpha() for c in body):
        return word
    return word[:start] + body[start:].translate(_SIGN_TABLE) + word[len(body) :]


def fold(text: str | None) -> str:
    """The folded words, each between single spaces. Words of digits alone stay numbers."""
    if not text:
        return " "
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGNED.sub(_unsigned, text)
    text = _NUMBER.sub(lambda m: m[0].translate(_ASIDE), text)
    return f" {' '.join(text.translate(_FOLD).split())} "


def _entries(folded: str, lengths: tuple[int, ...]) -> set[str]:
    """What may become an entry: each word (" word ") and each start of a word (" star")."""
    out = set()
    for word in set(folded.split()):
        if 3 <= len(word) <= 24:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in lengths if k <= len(word))
    return out


def _count_entries(lengths: tuple[int, ...]):
    """In each task: documents by entry, label and half; handed on whenever HELD entries are held."""

    def hand_on(counts):
        entry, toxic, half = zip(*counts)
        return batch(entry=pa.array(entry, pa.string()), toxic=pa.array(toxic, pa.int32()), half=pa.array(half, pa.int32()), n=pa.array(counts.values(), pa.int64()))

    def run(batches):
        counts: Counter = Counter()
        for part in batches:
            for text, toxic, half in zip(column(part, "text"), column(part, "toxic"), column(part, "half")):
                counts.update((e, toxic, half) for e in _entries(fold(text), lengths))
                if len(counts) >= HELD:
                    yield hand_on(counts)
                    counts = Counter()
        if counts:
            yield hand_on(counts)

    return run


def choose(toxic: dict[str, float], clean: dict[str, float], n_toxic: int, n_clean: int, rules: ToxicityRules) -> dict[str, float]:
    """The lexicon: entries by evidence, without those that a shorter chosen entry covers."""
    rate = (n_toxic + 1) / (n_toxic + n_clean + 2)
    scored = []
    for entry, t in toxic.items():
        c = clean.get(entry, 0)
        if t < rules.min_documents:
            continue
        weight = math.log(t + rules.prior) - math.log(n_toxic + 1) - math.log(c + rules.prior * max(1.0, n_clean / max(1, n_toxic))) + math.log(n_clean + 1)
        if weight >= rules.min_weight and _evidence(t, c, rate) >= rules.min_evidence:
            scored.append((-t * weight, len(entry), entry, weight))
    chosen: dict[str, float] = {}
    for _, _, entry, weight in sorted(scored):
        covered = any(entry[:k] in chosen for k in range(4, len(entry)))
        if not covered and not any(longer.startswith(entry) for longer in chosen):
            chosen[entry] = weight
    return chosen


def _evidence(t: float, c: float, rate: float) -> float:
    """The G statistic of t toxic documents among t + c, against the share of toxic documents."""
    share = t / (t + c)
    if share <= rate:
        return 0.0
    return 2 * (t * math.log(share / rate) + (c * math.log((1 - share) / (1 - rate)) if c else 0.0))


def automaton(lexicon: dict[str, float], harmless: tuple[str, ...] = HARMLESS) -> ahocorasick.Automaton:
    """Matches entries, and harmless phrases with the weight of the entries inside them taken back."""
    out = ahocorasick.Automaton()
    inside = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        out.add_word(entry, weight)
        inside.add_word(entry, weight)
    if not lexicon:
        out.add_word("  ", 0.0)
    else:
        inside.make_automaton()
        for phrase in harmless:
            taken = sum(weight for _, weight in inside.iter(f" {phrase} "))
            if taken:
                out.add_word(f" {phrase} ", -taken)
    out.make_automaton()
    return out


def phrases(matcher: ahocorasick.Automaton, folded: str) -> set[str]:
    """The phrases of two words around each match: with the word before, and with the word after."""
    out = set()
    for end, _ in matcher.iter(folded):
        last = folded.find(" ", end) if folded[end] != " " else end  # the space after the word in which the match ends
        first = folded.rfind(" ", 0, last)
        if first > 0:
            out.add(folded[folded.rfind(" ", 0, first) + 1 : last])
        if last < len(folded) - 1:
            out.add(folded[first + 1 : folded.find(" ", last + 1)])
    return out


def _count_phrases(lexicon: dict[str, float]):
    """In each task: documents by phrase around an entry, and by label."""

    def run(batches):
        matcher, counts = automaton(lexicon, ()), Counter()
        for part in batches:
            for text, toxic in zip(column(part, "text"), column(part, "toxic")):
                counts.update((p, toxic) for p in phrases(matcher, fold(text)))
        keys = list(counts)
        yield batch(phrase=pa.array([k[0] for k in keys], pa.string()), toxic=pa.array([k[1] for k in keys], pa.int32()), n=pa.array([counts[k] for k in keys], pa.int64()))

    return run


def features(matcher: ahocorasick.Automaton, text: str | None) -> tuple[float, float]:
    """The total weight, and the weight for each hundred words, both on a log scale."""
    folded = fold(text)
    total = max(0.0, sum(weight for _, weight in matcher.iter(folded)))
    return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; classes are balanced so that 0.5 is the even-odds point."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1)) * max(1.0, len(y) / 100)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass(frozen=True)
class ToxicityModel:
    """A lexicon and the curve from its features to a score."""

    lexicon: dict[str, float]
    curve: tuple[float, float, float]
    threshold: float = 0.7
    harmless: tuple[str, ...] = HARMLESS

    def scorer(self):
        matcher, (a, b, c) = automaton(self.lexicon, self.harmless), self.curve

        def score(text: str | None) -> float:
            x, y = features(matcher, text)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))

        return score


#: Used where there are no labels of both kinds to fit: any known insult is over the threshold.
FALLBACK_CURVE = (-4.0, 3.0, 1.0)
FALLBACK_WEIGHT = 4.0


def is_held_out() -> F.Column:
    """By the id as text; a null id counts as an empty one, which isn't held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """Learn from labelled rows that aren't held out; a bounded sample of them, the first by a hash of doc_id."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.max_labelled)
    # One text an id: what is collected below is bounded by the sample.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    train = materialize(rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")))
    counts = {(r.toxic, r.half): r["count"] for r in train.groupBy("toxic", "half").count().collect()}
    n = lambda kind, *halves: sum(counts.get((kind, h), 0) for h in halves)
    if not n(0, 0, 1) or not n(1, 0, 1):
        discard(train)
        return ToxicityModel({f" {w} ": FALLBACK_WEIGHT for w in INSULTS}, FALLBACK_CURVE, rules.threshold)
    tally = map_arrow(train, _count_entries(rules.prefix_lengths), "entry string, toxic int, half int, n long")
    of = lambda kind, half: F.sum(F.when((F.col("toxic") == kind) & (F.col("half") == half), F.col("n")).otherwise(0)).alias(f"{'ct'[kind]}{half}")
    counted = tally.groupBy("entry").agg(*(of(kind, half) for kind in (0, 1) for half in (0, 1)))

    def may(t: Column, c: Column, *k: int) -> Column:
        """Whether :func:`choose` could take an entry, by a weight that is no smaller than its own and by the same evidence."""
        rate, share = (n(1, *k) + 1) / (n(1, *k) + n(0, *k) + 2), t / (t + c)
        weight = F.log(t + rules.prior) - math.log(n(1, *k) + 1) - F.log(c + rules.prior) + math.log(n(0, *k) + 1)
        evidence = 2 * (t * F.log(share / rate) + F.when(c > 0, c * F.log((1 - share) / (1 - rate))).otherwise(0.0))
        return F.when(t >= rules.min_documents, (weight >= rules.min_weight) & (share > rate) & (evidence >= rules.min_evidence - 1e-6)).otherwise(False)

    # Only such entries come to the driver.
    t0, t1, c0, c1 = map(F.col, ("t0", "t1", "c0", "c1"))
    best = counted.where(may(t0 + t1, c0 + c1, 0, 1) | may(t0, c0, 0) | may(t1, c1, 1)).collect()
    lexicon = choose({r.entry: r.t0 + r.t1 for r in best}, {r.entry: r.c0 + r.c1 for r in best}, n(1, 0, 1), n(0, 0, 1), rules)
    halves = {h: choose({r.entry: r[f"t{h}"] for r in best}, {r.entry: r[f"c{h}"] for r in best}, n(1, h), n(0, h), rules) for h in (0, 1)}

    def unseen(batches):
        matchers = {h: automaton(halves[1 - h]) for h in (0, 1)}
        for part in batches:
            found = [features(matchers[h], text) for text, h in zip(column(part, "text"), column(part, "half"))]
            yield batch(a=pa.array([f[0] for f in found], pa.float64()), b=pa.array([f[1] for f in found], pa.float64()), y=pa.array(column(part, "toxic"), pa.int32()))

    points = map_arrow(train, unseen, "a double, b double, y int").toPandas()
    around = map_arrow(train.select("text", "toxic"), _count_phrases(lexicon), "phrase string, toxic int, n long").groupBy("phrase")
    sides = around.agg(*(F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in ((0, "clean"), (1, "bad"))))
    learned = sides.where(F.col("clean") >= rules.min_documents).where("bad = 0").orderBy("phrase").collect()
    discard(train)
    curve = _fit_curve(points[["a", "b"]].to_numpy(), points.y.to_numpy(float))
    return ToxicityModel(lexicon, tuple(map(float, curve)), rules.threshold, HARMLESS + tuple(r.phrase for r in learned))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs` (doc_id, text)."""

    def run(batches):
        scorer = model.scorer()
        for part in batches:
            scores = [scorer(text) for text in column(part, "text")]
            yield batch(
                doc_id=part.column(part.schema.get_field_index("doc_id")),
                score=pa.array(scores, pa.float64()),
                predicted=pa.array([int(s >= model.threshold) for s in scores], pa.int32()),
            )

    scored = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """Fit on the labels that aren't held out, then score every row of `docs`.

    Null and empty texts match nothing and get the lowest score. Labels that are null or neither 0 nor 1 are
    ignored; of several labels of one document the highest counts. A null id is scored, not held out, and has no label; of
    several texts of one id one is learned from. Without labels of both kinds the known insults and a fixed curve are used.
    Repeated rows are scored one by one; an empty table gives an empty result.
    """
    return score(docs, fit(docs, labels, rules))
