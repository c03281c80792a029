"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of five words is hashed once. The hash's first eight bits name one of 256 bins, and each bin keeps its
smallest hash. An empty bin takes the value of another: it probes bins in an order of its own (optimal densification), so
two texts with the same filled bins fill an empty one alike. Of each value the four lowest bits are packed, 16 bins in a
long. The likeness of two fingerprints is the share of equal bins, corrected for values that agree by chance.

A sort stands in for the minima: 256 end marks, one for each bin and larger than any hash in it, are sorted with a text's
hashes, and the first entry of each bin is its minimum, or the mark of an empty bin.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
KEPT_BITS = 4
PACKED = 64 // KEPT_BITS
#: Low bits of the mark that ends a bin.
MARK = (1 << (64 - BIN_BITS)) - 1
#: Probes of an empty bin by multiply-shift hashing; then all filled bins are met in an order of their own.
PROBES = 16
SEED = 13
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a bucket when documents are set beside their neighbours, and the most buckets there are (each has one broadcast row).
BUCKET_ROWS = 250
MAX_BUCKETS = 1 << 16


def _marks() -> Column:
    return F.array(*[F.lit(((i - BINS // 2) << (64 - BIN_BITS)) | MARK) for i in range(BINS)])


def _mark(value: Column) -> Column:
    return value.bitwiseAND(MARK) == MARK


def probe_tables(probes: int = PROBES, seed: int = SEED) -> list[list[int]]:
    """For each probe the bin that it tries for each bin, by multiply-shift hashing: ((a * i + b) mod 2 ** 32) >> 24, a odd."""
    draw = random.Random(seed)
    rules = [(draw.getrandbits(31) | 1, draw.getrandbits(31)) for _ in range(probes)]
    return [[((a * i + b) & ((1 << 32) - 1)) >> (32 - BIN_BITS) for i in range(BINS)] for a, b in rules]


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the packed fingerprint of its text column, an array of longs, under `name`.

    Each step is a column of its own that the next one names several times, so that Catalyst doesn't put it into a loop.
    A text of fewer words than a shingle is one shingle; a text without words has the one shingle of an empty word.
    """
    hashes, ordered, bins, full, dense = (f"_{name}_{step}" for step in ("hashes", "ordered", "bins", "full", "dense"))
    words = F.split(F.btrim(F.col(text), F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+")
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(1)))
    shingle = lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, SHINGLE)])
    begins = lambda v, i: (i == 0) | _mark(F.get(ordered, i - 1))
    number = lambda v: F.shiftright(v, 64 - BIN_BITS) + BINS // 2

    def filled(v: Column, i: Column) -> Column:
        """A bin's own value, or the first filled bin's among its probes, or that of the filled bin that ranks first for it."""
        probes = [F.get(bins, F.get(F.array(*map(F.lit, tried)), i)) for tried in probe_tables()]
        ranks = F.transform(full, lambda w: F.xxhash64(number(w), i).bitwiseAND(~(BINS - 1)).bitwiseOR(number(w)))
        chosen = F.when(F.size(full) > 0, F.array_min(ranks).bitwiseAND(BINS - 1).cast("int"))
        return F.coalesce(v, *probes, F.get(bins, chosen))

    pack = lambda total, v: F.shiftleft(total, KEPT_BITS).bitwiseOR(v.bitwiseAND((1 << KEPT_BITS) - 1))
    packed = F.array(*[F.aggregate(F.slice(dense, PACKED * k + 1, PACKED), F.lit(0).cast("long"), pack) for k in range(BINS // PACKED)])
    return (
        df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn(ordered, F.sort_array(F.concat(F.transform(starts, shingle), _marks())))
        .withColumn(bins, F.transform(F.filter(ordered, begins), lambda v: F.when(~_mark(v), v)))
        .withColumn(full, F.array_compact(bins))
        .withColumn(dense, F.transform(bins, filled))
        .withColumn(name, packed)
        .drop(hashes, ordered, bins, full, dense)
    )


def as_text(fingerprint: str) -> Column:
    """A packed fingerprint as lowercase hexadecimal digits, one for each bin."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.get(fingerprint, F.lit(k))), 16, "0") for k in range(BINS // PACKED)]))


def likeness(a: str, b: str) -> Column:
    """The estimated share of common shingles of two packed fingerprints, from 0 to 1.

    Bins of unlike texts agree in KEPT_BITS bits by chance, one in 16; the share of equal bins is corrected for it.
    """

    def unequal(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        y = x
        for shift in range(1, KEPT_BITS):
            y = y.bitwiseOR(F.shiftright(x, shift))
        return F.bit_count(y.bitwiseAND(0x1111111111111111))

    total = sum((unequal(k) for k in range(1, BINS // PACKED)), unequal(0))
    chance = 1 / (1 << KEPT_BITS)
    return F.greatest(F.lit(0.0), (1 - total / F.lit(float(BINS)) - chance) / (1 - chance))


def _above(edges: list[int], doc_id: Column, strict: bool) -> Column:
    """How many of the sorted edges are below a number (or equal to it, unless `strict`), by halving."""
    if not edges:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])

    def halve(at: Column, step: Column) -> Column:
        edge = F.get(table, at + step - 1)
        return F.when((edge < doc_id) if strict else (edge <= doc_id), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def bucketed(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` (doc_id, text, tie) with column bucket: later buckets hold smaller ids, and rows without an id come last.

    Edges are quantiles of the ids, so buckets are of like size. An id that spans several edges, or a null one, is dealt by tie.
    """
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")).first()
    wanted = min(MAX_BUCKETS // 2, -(-whole.named // bucket_rows))
    nameless = min(MAX_BUCKETS // 2, -(-(whole.n - whole.named) // bucket_rows))
    shares = [k / wanted for k in range(1, wanted)]
    edges = sorted(int(v) for v in rows.where("doc_id is not null").approxQuantile("doc_id", shares, 0.25 / wanted)) if shares else []
    part = F.col("tie") / F.lit(float(1 << 64)) + 0.5
    deal = lambda n: F.least(F.floor(part * n), n - 1)
    below, upto = _above(edges, F.col("doc_id"), True), _above(edges, F.col("doc_id"), False)
    named = F.lit(len(edges)) - upto + F.when(upto > below, deal(upto - below)).otherwise(0)
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(edges) + 1) + deal(F.lit(max(nameless, 1)))).otherwise(named).cast("int"))


def beside_next(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` (doc_id, text, tie), each with bucket, and the first row of the next bucket as a guest (guest = 1) in each.

    The first row of each bucket is found from ids and ties alone; one row a bucket, at most MAX_BUCKETS, is broadcast.
    """
    placed = bucketed(rows, bucket_rows)
    heads = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("eit"))).alias("head"))
    order = Window.orderBy("bucket")  # over one row a bucket
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    host = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(everything))
    hosts = heads.select(F.col("head.doc_id").alias("_id"), F.bitwise_not("head.eit").alias("_tie"), host.alias("_host"))
    met = placed.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    homes = F.when(F.col("_host").isNull(), F.array("bucket")).otherwise(F.array("bucket", "_host"))
    return met.select("doc_id", "text", "tie", F.posexplode(homes).alias("guest", "bucket"))


def document_fingerprints(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of `docs`
    (doc_id, text).

    The next document is the one of the next smaller id; after the last comes the first. Rows of one id follow each other by a
    64-bit hash of their texts and then the texts, and rows without an id come last. A null text is empty. Repeated rows are
    kept; other columns are ignored; an empty table gives an empty result; a single row is its own next one. Equal texts have
    equal fingerprints, and a likeness of 1 unless an edit changes them. Copies of one text under one id stay in one bucket.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    own = with_fingerprint(beside_next(rows, bucket_rows).repartition("bucket"), "text", "own")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "tie", "text")
    pairs = own.select("*", F.lead("text").over(order).alias("next_text"), F.lead("own").over(order).alias("next_own")).where("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    edited = with_fingerprint(pairs.withColumn("n_chars", n.cast("long")).withColumn("edited_text", changed).drop("text", "next_text"), "edited_text", "edited")
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
