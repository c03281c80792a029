"""Best-fit packing with certified bounds.

Pieces of documents are dealt to partitions by hash and packed there by best-fit decreasing. Dual feasible functions
give a lower bound on the sequences a partition needs. A partition that meets its bound is certified and gives up
only its emptiest sequence; one with a gap gives up as many of its emptiest sequences as could close the gap, and
one more. The documents given up by all partitions are exchanged: dealt anew to fewer partitions and packed again, until one
partition is left. What a task holds is bounded: pieces of one partition, and later a few sequences of each
partition that it takes over.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import coder
from tidemark.llm.common import batch, column, map_arrow
from tidemark.session import discard, materialize, ship

#: Fixed values of the contract: the id that ends each document, and a sequence's tokens.
END_ID = 1
CAPACITY = 4096


@dataclass(frozen=True)
class PackingRules:
    """A sequence's capacity, pieces to a partition, how many partitions' leftovers meet, and the functions tried for bounds."""

    capacity: int = CAPACITY
    partition_pieces: int = 60_000
    fan_in: int = 16
    functions: int = 24


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each item. Bins wait by free space; a bit set finds the tightest that fits."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = bins = 0
    for at, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = waiting[space].pop()
            if not waiting[space]:
                free ^= 1 << space
        else:
            space, bin_ = capacity, bins
            bins += 1
        out[at] = bin_
        rest = space - length
        if rest:
            if not waiting[rest]:
                free |= 1 << rest
            waiting[rest].append(bin_)
    return out


def bound(lengths: np.ndarray, capacity: int, functions: int = 24) -> int:
    """Fewest bins that items of 1 to `capacity` may need, as far as dual feasible functions tell.

    For k >= 1 and a cut-off c up to half the capacity, items shorter than c count nothing, items longer than
    capacity - c count a whole bin, and the others count u_k(x): x itself where (k + 1) x is an integer, else
    floor((k + 1) x) / k, with x the length as a share of the capacity. k = 0 stands for u(x) = x.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    cuts = np.arange(capacity // 2 + 1)
    whole = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])[capacity - cuts + 1]
    best = 0
    for k in range(functions + 1):
        if k == 0:
            value, unit = sizes, capacity
        else:
            times = (k + 1) * sizes
            value, unit = np.where(times % capacity == 0, k * sizes, times // capacity * capacity), k * capacity
        sums = np.concatenate([[0], np.cumsum(counts * value)])
        middle = sums[capacity - cuts + 1] - sums[cuts]
        best = max(best, int(np.max(-(-(middle + whole * unit) // unit))))
    return best


def pieces(docs: DataFrame, vocabulary: str, rules: PackingRules = PackingRules()) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: each document's ids and an end id, cut only beyond the capacity."""
    capacity = rules.capacity

    def run(batches):
        bpe, end = coder(vocabulary), array("I", [END_ID]).tobytes()
        for part in batches:
            rows = []
            for doc_id, raw in zip(column(part, "doc_id"), bpe.encode_all(column(part, "text"))):
                raw += end
                total = len(raw) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    rows.append((doc_id, piece, start, min(capacity, total - start), zlib.crc32(raw[4 * start : 4 * (start + capacity)])))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield batch(**{n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("doc_id", "piece", "start", "length", "ids_crc32"), types))})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _given_up(bins: np.ndarray, lengths: np.ndarray, least: int, capacity: int) -> np.ndarray:
    """The bins to exchange: the emptiest, one more than the gap; a full one never."""
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    emptiest = np.argsort(fill, kind="stable")[: len(fill) - least + 1]
    return emptiest[fill[emptiest] < capacity]


def _pack_partition(rules: PackingRules, turn: int, last: bool):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = part.column("length").to_numpy()
        bins = pack(lengths, rules.capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        ahead = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.empty(len(bins), dtype=np.int64)
        offset[order] = ahead - np.repeat(ahead[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
        loose = np.zeros(int(bins.max()) + 1, dtype=bool)
        if not last:
            loose[_given_up(bins, lengths, bound(lengths, rules.capacity, rules.functions), rules.capacity)] = True
        base = (turn << 56) + (part.column("part")[0].as_py() << 28)
        out = part.drop_columns(["part"])
        return (
            out.append_column("sequence_id", pa.array(base + bins, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("loose", pa.array(loose[bins], pa.bool_()))
        )

    return run


def best_fit(pieces_: DataFrame, rules: PackingRules = PackingRules()) -> DataFrame:
    """Assign each piece a sequence and an offset; `pieces_` is read once for each of a logarithmic number of turns.

    Pieces are dealt by id and place in the table, so that repeated rows, as of many null ids, are spread too.
    """
    ship(pieces_.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose boolean"
    left, done, turn = pieces_, None, 0
    partitions = max(1, -(-left.count() // rules.partition_pieces))
    while True:
        last = partitions == 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(turn)), F.lit(partitions)).cast("int"))
        packed = materialize(dealt.groupBy("part").applyInArrow(_pack_partition(rules, turn, last), schema))
        settled = packed.where("not loose").drop("loose")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        left = packed.where("loose").drop("loose", "sequence_id", "offset")
        partitions, turn = -(-partitions // rules.fan_in), turn + 1


def pack_documents(docs: DataFrame, vocabulary: str, rules: PackingRules = PackingRules()) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id alone. Rows with equal ids are packed each for itself;
    other columns are ignored; an empty table gives an empty result. Only documents beyond the capacity are cut.
    """
    cut = materialize(pieces(docs, vocabulary, rules))
    out = best_fit(cut, rules)
    discard(cut)
    return out
