"""Casts, normalisation, dates and numbers as Column expressions."""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

DAYS_A_YEAR = 365.25


def finite_number(x: Column) -> Column:
    """A double, or null where the text is blank, no number, NaN or infinite."""
    value = F.nullif(F.trim(x.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def positive_number(x: Column) -> Column:
    value = finite_number(x)
    return F.when(value > 0, value)


def strict_boolean(x: Column) -> Column:
    """True for 'True', false for 'False'; anything else is an error."""
    return F.when(x == "True", True).when(x == "False", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(x, F.lit("null")))))


def tri_state(x: Column) -> Column:
    """1, 0 or null by the usual words."""
    word = F.lower(F.trim(x))
    return F.when(word.isin("true", "yes", "1", "y"), 1).when(word.isin("false", "no", "0", "n"), 0)


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


@cache
def _compatible() -> dict[str, str]:
    """Of each character beyond ASCII, the letters a-z and digits in its compatibility decomposition (NFKD), if any."""
    kept = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
    found = ((chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x in kept)) for c in range(0x80, sys.maxunicode + 1))
    return {c: plain for c, plain in found if plain}


def _ranges(chars: list[str]) -> str:
    """A pattern's class of characters, as ranges."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


def compatible_letters(x: Column) -> Column:
    """Characters beyond ASCII as the letters a-z and digits that they decompose to (NFKD); those without any stay as they are.

    Texts of ASCII alone, told by their number of bytes, are left alone. Of others the characters beyond ASCII are taken out, and only the
    distinct ones among them that have letters are looked up and replaced; so the table is met by few characters, not by every one.
    """
    table = _compatible()
    single = [c for c, plain in table.items() if len(plain) == 1]
    several = [c for c, plain in table.items() if len(plain) > 1]
    spelled = F.map_from_arrays(F.lit(several), F.lit([table[c] for c in several]))
    beyond = F.regexp_replace(x, r"[\x00-\x7F]+", "")
    found = lambda chars: F.array_distinct(F.regexp_extract_all(beyond, F.lit(_ranges(chars)), F.lit(0)))
    plain = F.translate(F.array_join(found(single), ""), "".join(single), "".join(table[c] for c in single))
    folded = F.call_function("translate", x, F.array_join(found(single), ""), plain)
    out = F.aggregate(found(several), folded, lambda text, c: F.replace(text, c, F.element_at(spelled, c)))
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(out)


def normal_key(x: Column, without: tuple[str, ...] = ()) -> Column:
    """Lower case, decomposed (NFKD), everything but a-z and digits gone; words named in `without` (modes like 'thinking') are dropped first."""
    folded = compatible_letters(F.lower(x))
    if without:
        folded = F.regexp_replace(folded, r"(?<![a-z0-9])(?:" + "|".join(without) + r")(?![a-z0-9])", "")
    return F.regexp_replace(folded, "[^a-z0-9]+", "")


def accepted(x: Column, allowed: tuple[str, ...] = (), contains: tuple[str, ...] = (), pattern: str | None = None) -> Column:
    """Whether a text passes all of the tests that are given: one of a list, holding one of some literals in any case, matching a pattern. Null doesn't."""
    tests = [x.isNotNull()]
    if allowed:
        tests.append(x.isin(*allowed))
    if contains:
        tests.append(F.exists(F.lit([c.lower() for c in contains]), lambda c: F.contains(F.lower(x), c)))
    if pattern:
        tests.append(x.rlike(pattern))
    return F.coalesce(F.forall(F.array(*tests), lambda t: t), F.lit(False))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def classify(x: Column, needles: list[tuple[str, str]], other: str) -> Column:
    """The label of the first needle that occurs in the text."""
    low, out = F.lower(x), F.lit(other)
    for needle, label in reversed(needles):
        out = F.when(low.contains(needle), label).otherwise(out)
    return out


def magnitude(x: Column) -> Column:
    """'128k', '2.8T', '<5m' as numbers; what isn't one is null."""
    text = F.lower(F.trim(x))
    number = F.nullif(F.regexp_extract(text, r"^<?\s*([0-9]+(?:\.[0-9]+)?)\s*([kmbt]?)$", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(text, r"^<?\s*([0-9]+(?:\.[0-9]+)?)\s*([kmbt]?)$", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "t", 1e12).otherwise(1.0)
    return number * factor


def is_floor(x: Column) -> Column:
    return F.trim(x).startswith("<")


def key_part(x: Column, part: int, default: str) -> Column:
    """A part of an 'endpoint::tier' key, or the default where it is missing."""
    return F.coalesce(F.nullif(F.split_part(x, F.lit("::"), F.lit(part)), F.lit("")), F.lit(default))


def normal_url(x: Column) -> Column:
    """Lower case, without query, fragment, '/tree/main' or '/tree/master', and slashes at the end; the scheme stays."""
    bare = F.regexp_replace(F.lower(F.trim(x)), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/tree/(?:main|master)/?$", ""), r"/+$", "")


def years_since(day: Column, origin: str) -> Column:
    return F.datediff(day, F.lit(origin).cast("date")) / F.lit(DAYS_A_YEAR)


def decimal_year(day: Column) -> Column:
    year = F.year(day)
    length = F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))
    return year + (F.dayofyear(day) - 1) / length


def compact_date(x: Column) -> Column:
    """The date of a YYYYMMDDhhmmss stamp."""
    return F.try_to_timestamp(F.substring(x, 1, 14), F.lit("yyyyMMddHHmmss")).cast("date")


def epoch_date(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("date")


def clipped_logit(p: Column, margin: float = 1e-3) -> Column:
    q = F.greatest(F.lit(margin), F.least(F.lit(1 - margin), p))
    return F.log(q / (1 - q))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def geometric_midpoint(low: Column, high: Column) -> Column:
    return F.sqrt(low * high)


def multiplicative_error(predicted: Column, actual: Column) -> Column:
    return F.greatest(predicted / actual, actual / predicted)


def json_pointer(*parts: Column) -> Column:
    """A JSON pointer with '~' and '/' escaped."""
    return F.concat(*(F.concat(F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for p in parts))


def scrub_paths(x: Column) -> Column:
    """Absolute paths of home folders without the user's name."""
    return F.regexp_replace(x, r"(/(?:home|Users)/)[^/\s\"]+", "$1_")


def portable_paths(x: Column, root: str, home: str) -> Column:
    """Paths under `root` from '.', then paths under `home` from '~', with slashes of either kind; a longer name that begins alike stays."""
    for folder, mark in ((root, "."), (home, "~")):
        for slash in ("/", "\\"):
            x = F.replace(x, F.lit(folder.rstrip("/").replace("/", slash) + slash), F.lit(mark + slash))
    return x


def without_identities(records: Column, fields: tuple[str, ...]) -> Column:
    """An array of records in which each named text field holds its own name in brackets, so that redacted and full records compare."""

    def redacted(record: Column) -> Column:
        for name in fields:
            record = record.withField(name, F.lit(f"<{name}>"))
        return record

    return F.transform(records, redacted)


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def in_parentheses(x: Column) -> Column:
    """What the last pair of parentheses at the end of a name holds; null if there is none."""
    return F.nullif(F.regexp_extract(x, r"\(([^()]*)\)\s*$", 1), F.lit(""))


def without_suffix(x: Column, *suffixes: str) -> Column:
    """A name without one of the suffixes and the sign before it."""
    return F.regexp_replace(x, r"(?i)[-_: ](" + "|".join(suffixes) + r")$", "")


def iso_date(x: Column) -> Column:
    """A date of the form YYYY-MM-DD that the calendar has, else null."""
    return F.when(F.regexp_like(x, F.lit(r"^\d{4}-\d{2}-\d{2}$")), x.try_cast("date"))


def named_month_date(x: Column) -> Column:
    """A date like 'March 5, 2024' or '5 Mar 2024', else null."""
    month = F.lower(F.substring(F.regexp_extract(x, r"([A-Za-z]{3,9})", 1), 1, 3))
    number = F.array_position(F.array(*map(F.lit, "jan feb mar apr may jun jul aug sep oct nov dec".split())), month)
    day, year = F.regexp_extract(x, r"(?<!\d)(\d{1,2})(?!\d)", 1), F.regexp_extract(x, r"(\d{4})", 1)
    return F.when((number > 0) & (day != "") & (year != ""), F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date"))


def implied_index(difficulty: Column, slope: Column, share: Column) -> Column:
    """The ability at which an item of a difficulty and slope is solved with a probability."""
    return difficulty + clipped_logit(share) / slope


def fixed(x: Column, digits: int) -> Column:
    """A number as text with so many digits after the point; null stays null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(100 * x, digits), F.lit("%"))


def canonical_json(columns: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and no spaces; null fields stay in it."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def architecture(leaves: Column, values: Column) -> tuple[Column, Column]:
    """From a config's leaf names and numbers: 'mixture' or 'dense', and the largest number of experts.

    A leaf whose name speaks of experts with a number over one makes a mixture.
    """
    experts = F.transform(F.filter(F.arrays_zip(leaves.alias("leaf"), values.alias("value")), lambda p: F.regexp_like(p["leaf"], F.lit(r"(?i)experts?(_|$)"))), lambda p: p["value"])
    most = F.array_max(experts)
    return F.when(most > 1, "mixture").otherwise("dense"), most


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff-Obershelp similarity of two texts; nulls count as empty. Arrow batches, since Spark has no such function."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)], dtype=float)


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or tiny)
        c = (1 + step / c) or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, degrees: pd.Series) -> pd.Series:
    """The two-sided p-value of Student's t; null where the degrees of freedom aren't positive."""
    return pd.Series([_beta_tail(n / 2, 0.5, n / (n + x * x)) if n > 0 and x == x else None for x, n in zip(t, degrees)], dtype=float)
