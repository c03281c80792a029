"""Packed token ids as binary rows.

Each task encodes its documents and packs them, a bounded buffer at a time, by best-fit decreasing; a segment tree
over free capacities finds the tightest open sequence. Well-filled sequences are written, and the documents of the
others wait for the next buffer. What a task can't fill at its end is exchanged: the loose sequences of all tasks
meet in as few tasks as a buffer's size allows and are packed again, so that the fill doesn't depend on how many
partitions a table has. Documents longer than a sequence are split losslessly. A row holds one sequence: its ids as
little-endian numbers padded to the capacity, two bytes an id if the vocabulary allows that and else four, the cumulative
lengths of its segments, and the places where positions start again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import coder
from tidemark.llm.common import batch, column, map_arrow
from tidemark.llm.packing import CAPACITY, END_ID
from tidemark.session import materialize

SCHEMA = (
    "sequence_id long, n_tokens int, n_segments int, id_bytes int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, starts array<long>, ids_crc32 long"
)
_TYPES = (
    pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_()
)
_NAMES = ("sequence_id", "n_tokens", "n_segments", "id_bytes", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "starts", "ids_crc32", "loose")


@dataclass(frozen=True)
class TokenRules:
    """A sequence's capacity, the buffer's tokens, the fill from which a sequence is written at once, and the padding."""

    capacity: int = CAPACITY
    buffer_tokens: int = 4_000_000
    written_fill: float = 0.98
    pad_id: int = 0


def id_bytes(vocabulary: str) -> int:
    """Two bytes an id where all ids of the vocabulary and the end fit, else four."""
    return 2 if max(*coder(vocabulary).texts, END_ID) < 1 << 16 else 4


class CapacityTree:
    """A segment tree over free capacities: how many open bins have each, and the smallest that is at least a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, space: int, by: int) -> None:
        node = self.leaves + space
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, space: int, bin_: int) -> None:
        self.open[space].append(bin_)
        if len(self.open[space]) == 1:
            self._change(space, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest open bin with room for the length, and its space; None if there is none."""
        counts, node = self.counts, self.leaves + length
        if not counts[node]:
            while node > 1 and not (node % 2 == 0 and counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        space = node - self.leaves
        bin_ = self.open[space].pop()
        if not self.open[space]:
            self._change(space, -1)
        return bin_, space


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: of each bin, the items in the order in which they came."""
    tree, bins = CapacityTree(capacity), []
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[at])
        if found is None:
            found = len(bins), capacity
            bins.append([])
        bins[found[0]].append(at)
        if found[1] > lengths[at]:
            tree.put(found[1] - lengths[at], found[0])
    return bins


Segment = tuple[int | None, int, np.ndarray]


class _Writer:
    """Packs segments as they come: well-filled sequences become rows at once, others wait, and the last ones are loose."""

    def __init__(self, rules: TokenRules, width: int, base: int, last: bool):
        self.rules, self.width, self.base, self.last = rules, width, base, last
        self.held: list[Segment] = []
        self.tokens, self.limit, self.made = 0, rules.buffer_tokens, 0

    def add(self, segment: Segment) -> Iterator[pa.RecordBatch]:
        self.held.append(segment)
        self.tokens += len(segment[2])
        if self.tokens >= self.limit:
            yield from self.write(False)
            self.limit = max(self.rules.buffer_tokens, 2 * self.tokens)

    def write(self, end: bool) -> Iterator[pa.RecordBatch]:
        capacity, kind = self.rules.capacity, np.dtype(f"<u{self.width}")
        rows, kept = [], []
        for members in fill([len(x[2]) for x in self.held], capacity):
            segments = [self.held[i] for i in members]
            total = sum(len(x[2]) for x in segments)
            filled = total >= self.rules.written_fill * capacity
            if not end and not filled:
                kept += segments
                continue
            ids = np.full(capacity, self.rules.pad_id, dtype=kind)
            ids[:total] = np.concatenate([x[2] for x in segments])
            ends = np.cumsum([0] + [len(x[2]) for x in segments])
            raw = ids.tobytes()
            crc = zlib.crc32(raw[: total * self.width])
            rows.append((self.base + self.made, total, len(segments), self.width, raw, ends, ends[:-1], [x[0] for x in segments], [x[1] for x in segments], crc, not (filled or self.last)))
            self.made += 1
        self.held, self.tokens = kept, sum(len(x[2]) for x in kept)
        for at in range(0, len(rows), 256):
            yield batch(**{n: pa.array([r[i] for r in rows[at : at + 256]], t) for i, (n, t) in enumerate(zip(_NAMES, _TYPES))})


def _segments(part: pa.RecordBatch | pa.Table) -> Iterator[Segment]:
    """The segments of packed rows."""
    names = ("id_bytes", "input_ids", "cu_seqlens", "doc_ids", "starts")
    for width, raw, ends, docs, starts in zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)):
        ids = np.frombuffer(raw, dtype=f"<u{width}")
        for doc_id, start, a, b in zip(docs, starts, ends, ends[1:]):
            yield doc_id, start, ids[a:b]


def _pack_again(rules: TokenRules, width: int, turn: int, last: bool):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("sequence_id")
        writer = _Writer(rules, width, (turn << 56) + (part.column("part")[0].as_py() << 28), last)
        made = [row for segment in _segments(part) for row in writer.add(segment)]
        return pa.Table.from_batches([*made, *writer.write(True)])

    return run


def packed_rows(docs: DataFrame, vocabulary: str, rules: TokenRules = TokenRules()) -> DataFrame:
    """One row per sequence, over every row of `docs` (doc_id, text); see SCHEMA.

    A null or empty text is a segment that holds the end id alone. A null id stays null. Repeated rows are packed each
    for itself; other columns are ignored; an empty table gives an empty result. `starts` has each segment's place in its
    document, so that long documents can be put together again.
    """
    capacity, width = rules.capacity, id_bytes(vocabulary)

    def run(batches):
        bpe = coder(vocabulary)
        writer = _Writer(rules, width, TaskContext.get().partitionId() << 28, False)
        for part in batches:
            for doc_id, raw in zip(column(part, "doc_id"), bpe.encode_all(column(part, "text"))):
                whole = np.append(np.frombuffer(raw, dtype="<u4").astype(f"<u{width}"), np.array(END_ID, dtype=f"<u{width}"))
                for start in range(0, len(whole), capacity):
                    yield from writer.add((doc_id, start, whole[start : start + capacity].copy()))
        yield from writer.write(True)

    schema = SCHEMA + ", loose boolean"
    packed = materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema))
    done, turn, before = packed.where("not loose"), 0, None
    while tokens := packed.where("loose").agg(F.sum("n_tokens")).first()[0]:
        turn += 1
        # The last turn is that of one part, or that in which the turn before has filled little.
        parts = -(-tokens // rules.buffer_tokens)
        last = parts == 1 or (before is not None and 2 * tokens > before)
        dealt = packed.where("loose").drop("loose").withColumn("part", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(parts)))
        packed = materialize(dealt.groupBy("part").applyInArrow(_pack_again(rules, width, turn, last), schema))
        done, before = done.unionByName(packed.where("not loose")), tokens
    return done.drop("loose")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet: binary id matrices with their segment tables, one row to a sequence."""
    packed.write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """The segments again: doc_id, start and the ids of each, from the packed rows."""

    def run(batches):
        for part in batches:
            rows = [(doc_id, start, ids.tolist()) for doc_id, start, ids in _segments(part)]
            yield batch(doc_id=pa.array([r[0] for r in rows], pa.int64()), start=pa.array([r[1] for r in rows], pa.int64()), ids=pa.array([r[2] for r in rows], pa.list_(pa.int32())))

    return map_arrow(packed.select("id_bytes", "input_ids", "cu_seqlens", "doc_ids", "starts"), run, "doc_id long, start long, ids array<int>")
