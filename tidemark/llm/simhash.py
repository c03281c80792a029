"""Near-duplicates by SimHash, with pigeonring candidate filtering.

A fingerprint's 64 bits form a ring of segments. If two fingerprints differ in at most t bits, then on some start
of the ring the differences of the first l segments together stay within l * t / m, for every l up to the number of
segments m. With t = 4 and m = 5 the first segment is equal, the first two differ in at most one bit, and so on. So
fingerprints meet on keys of a start's first two segments, one of them with one bit set more; longer chains prune
the pairs that meet, and only what is left gets the full check. Equal fingerprints are one to begin with, and a
key of many fingerprints hands on links that span what its chains and the full check leave, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, column, map_arrow
from tidemark.llm.components import components
from tidemark.session import materialize, shuffle_partitions

#: Fixed values of the contract.
SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Segments of the ring: their first bits and widths.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
#: From this many fingerprints on, those of one key are linked around a pivot instead of pair by pair.
PIVOT_FROM = 64


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    words = text.encode("utf-8").lower().split() if text else []  # bytes: only A-Z, only the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint, as a signed number with the same bits, of every row of `docs` (doc_id, text)."""

    def run(batches):
        for part in batches:
            found = np.array([fingerprint(text) for text in column(part, "text")], dtype=np.uint64)
            yield batch(doc_id=part.column(part.schema.get_field_index("doc_id")), fp=pa.array(found.view(np.int64)))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def ring_keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints: for each start, the first two segments as they are, and with one more bit of the second set.

    Of two fingerprints whose second segments differ in one bit, one lacks it, and meets the other on its exact key.
    """
    keys, owners = [], []
    segments = [(found >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(STARTS, WIDTHS)]
    for i in range(len(WIDTHS)):
        j = (i + 1) % len(WIDTHS)
        head = (np.uint64(i) << np.uint64(26)) | (segments[i] << np.uint64(13))
        keys.append(head | segments[j])
        owners.append(found)
        for bit in range(WIDTHS[j]):
            lacks = (segments[j] >> np.uint64(bit)) & np.uint64(1) == 0
            keys.append((head | segments[j] | np.uint64(1 << bit))[lacks])
            owners.append(found[lacks])
    return np.concatenate(keys), np.concatenate(owners)


def chain_holds(difference: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether, from a start of the ring, the differing bits of ever longer chains stay within their budgets."""
    out = np.ones(len(difference), dtype=bool)
    total = np.zeros(len(difference), dtype=np.int64)
    masks = np.array([((1 << w) - 1) << s for s, w in zip(STARTS, WIDTHS)], dtype=np.uint64)
    for length in range(1, len(WIDTHS) + 1):
        total += np.bitwise_count(difference & masks[(start + length - 1) % len(WIDTHS)])
        out &= total * len(WIDTHS) <= length * DISTANCE
    return out


def _linked(found: np.ndarray, one: int, start: int) -> np.ndarray:
    """Which fingerprints are linked with one of them: by the chain from a start first, and what is left by all bits."""
    difference = found ^ found[one]
    out = chain_holds(difference, np.full(len(found), start))
    out[out] = np.bitwise_count(difference[out]) <= DISTANCE
    return out


def _span(found: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that span the linked ones among many fingerprints of one key: around a pivot first, then the rest against all."""
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    centre = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(found), bitorder="little").view("<u8")[0]
    pivot = int(np.argmin(np.bitwise_count(found ^ centre)))
    near = _linked(found, pivot, start)
    label = np.where(near, pivot, np.arange(len(found)))
    links = [(int(found[pivot]), int(found[k])) for k in np.flatnonzero(near) if k != pivot]
    for k in np.flatnonzero(~near):
        met = np.flatnonzero(_linked(found, k, start))
        for other in np.unique(label[met]):
            if other != label[k]:
                links.append((int(found[k]), int(found[met[np.flatnonzero(label[met] == other)[0]]])))
                label[label == other] = label[k]
    return links


def _links_of_keys(batches):
    """Rows sorted by key: links among the fingerprints of each key. A key's rows may run over several batches."""
    held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(keys, found):
        change = np.flatnonzero(np.diff(keys)) + 1
        firsts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(keys)]])
        sizes = ends - firsts
        a, b, start = [], [], []
        small = (sizes > 1) & (sizes < PIVOT_FROM)
        for size in np.unique(sizes[small]):
            at = firsts[small & (sizes == size)]
            for gap in range(1, size):
                for first in range(size - gap):
                    a.append(found[at + first]), b.append(found[at + first + gap]), start.append(keys[at] >> 26)
        out = []
        if a:
            a, b, start = np.concatenate(a), np.concatenate(b), np.concatenate(start)
            kept = chain_holds(a ^ b, start)
            a, b = a[kept], b[kept]
            kept = (np.bitwise_count(a ^ b) <= DISTANCE) & (a != b)
            out.append(np.column_stack([a[kept], b[kept]]))
        for first, end in zip(firsts[sizes >= PIVOT_FROM], ends[sizes >= PIVOT_FROM]):
            spanned = _span(np.unique(found[first:end]), int(keys[first] >> 26))
            if spanned:
                out.append(np.array(spanned, dtype=np.uint64))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.uint64)
        return batch(a=pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), b=pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)))

    for part in batches:
        keys = np.concatenate([held_keys, part.column(0).to_numpy()])
        found = np.concatenate([held, part.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1]))
        held_keys, held = keys[cut:], found[cut:]
        if cut:
            yield links(keys[:cut], found[:cut])
    if len(held):
        yield links(held_keys, held)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp that connect what differs in at most DISTANCE bits."""

    def run(batches):
        for part in batches:
            keys, owners = ring_keys(part.column(0).to_numpy().view(np.uint64))
            yield batch(key=pa.array(keys.view(np.int64)), fp=pa.array(owners.view(np.int64)))

    rows = map_arrow(distinct.select("fp"), run, "key long, fp long")
    dealt = rows.repartition(shuffle_partitions(distinct.sparkSession), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_links_of_keys, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of `docs` (doc_id, text).

    A text without words, or null, has fingerprint zero and is linked like any other; fewer words than a shingle make one
    shingle. Repeated rows are kept; other columns are ignored; an empty table gives an empty result. Links are between ids:
    texts of one id are reachable from each other if it is the smallest of theirs. A null id never names a component; rows of
    a fingerprint that only null ids have get a null one.
    """
    found = materialize(fingerprints(docs))
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(distinct)
    u = distinct.select(F.col("fp").alias("a"), F.col("least").alias("u"))
    v = distinct.select(F.col("fp").alias("b"), F.col("least").alias("v"))
    groups = components(links.join(u, "a").join(v, "b").select("u", "v"))
    members = distinct.join(groups, distinct["least"] == groups["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return found.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
