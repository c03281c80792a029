"""Suffix-array dedup of passages, over a sparse suffix array that is sorted bucket by bucket.

A window of MATCH bytes holds one anchor, the SEED-byte string in it with the smallest hash, so equal windows of any
two documents hold the same anchor at the same place. Only suffixes that start at anchors are sorted:

1. Exact copies of a document with a smaller id are marked; they need no search.
2. The distinct anchors of each bucket of documents are dealt by hash, each with how often it occurs and whether two
   documents hold it, and two bits for each come back: whether the corpus has it in two documents or more, and whether
   it is too common for one task to meet all its contexts. Only anchors of two documents stay.
3. Their contexts, MATCH bytes to the right and what a window may hold to the left, are dealt by the same hash. Equal
   contexts of one task are one: the smallest document stands for them, and the others are covered already.
4. In each bucket the right contexts and the reversed left contexts are sorted deep-shallow: multikey quicksort to a
   shallow depth, then a blind trie for each group that is still together. Neighbours' common prefixes give each
   window an identity, and a window whose identity also occurs in a smaller document is removed.
5. Windows of very common anchors are dealt one by one, by 128 bits of their own bytes, so that differing surroundings
   of one line part. Each bucket sends a window for its smallest document only.
6. Spans meet their documents again.

Rows between the steps are compressed arrays, one for each pair of buckets, and Spark deals them. The text itself
is shuffled once: the plan's three uses of it share one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import input_bytes, materialize, shuffle_partitions, ship

#: Fixed value of the contract: the shortest string that counts as repeated.
MATCH = 50
#: Bytes of an anchor, what a window may hold before it, and the bytes of one slice of work.
SEED = 16
LEFT = MATCH - SEED
SLICE = 1 << 20
_RIGHT = np.arange(MATCH)
_BEFORE = np.arange(1, LEFT + 1)
_INDEX_BITS = np.uint64(22)
_LOW = (np.uint64(1) << _INDEX_BITS) - np.uint64(1)
#: Depth to which multikey quicksort goes, in eight-byte characters, and the segments that it leaves to a plain sort.
SHALLOW_WORDS = 3
SMALL_SEGMENT = 256


@dataclass(frozen=True)
class SuffixRules:
    """Bytes of text that one bucket should hold, the occurrences from which on an anchor's windows are dealt one by one,
    and the rows from which on a group of exact copies isn't shuffled to one task; there are at most `hot_groups` such."""

    bucket_bytes: int = 32_000_000
    hot_anchor: int = 200_000
    hot_copies: int = 10_000
    hot_groups: int = 100_000


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(len(a.tobytes()) for a in arrays)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def load(value: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


# ---------------------------------------------------------------- texts of a bucket


class Texts:
    """The documents of one bucket in a fixed order, their bytes in one buffer with room on both sides."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("tag", "ascending")])
        self.doc_id = table.column("doc_id").to_numpy()
        self.tag = table.column("tag").to_numpy()
        self.table = table.drop_columns(["text"])
        chunks = [c.cast(pa.large_string()).cast(pa.large_binary()) for c in table.column("text").chunks]
        ends = [np.frombuffer(c.buffers()[1], "<i8", len(c) + 1, 8 * c.offset) for c in chunks]
        self.length = np.concatenate([np.zeros(0, np.int64), *(np.diff(e) for e in ends)])
        self.start = MATCH + np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.zeros(int(self.start[-1]) + MATCH + 8, dtype=np.uint8)
        at = MATCH
        for chunk, end in zip(chunks, ends):
            size = int(end[-1] - end[0])
            if size:
                self.bytes[at : at + size] = np.frombuffer(chunk.buffers()[2], np.uint8, size, int(end[0]))
            at += size

    def marked(self, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Which documents are among the given (id, tag) pairs."""
        wanted = set(zip(ids.tolist(), tags.tolist()))
        return np.fromiter(((i, t) in wanted for i, t in zip(self.doc_id.tolist(), self.tag.tolist())), bool, len(self.doc_id))


def _grams(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number."""
    out = raw.astype(np.uint64)
    for step in (1, 2, 4):
        out = out[:-step] | (out[step:] << np.uint64(8 * step))
    return out


def seed_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of the two halves of a seed."""
    h = first * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += second * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(31)
    return h


def anchors(raw: np.ndarray, window_ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows for which `window_ok` holds (one flag for each window's start)."""
    grams = _grams(raw)
    hashes = seed_hash(grams[:-8], grams[8:])[: len(window_ok) + LEFT]
    ranked = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    width, least = 1, ranked
    while 2 * width <= LEFT + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LEFT + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    places = (least[: len(window_ok)] & _LOW).astype(np.int64)[window_ok]
    if len(places):
        places = places[np.concatenate([[True], places[1:] != places[:-1]])]
    return places, hashes[places]


def bucket_anchors(texts: Texts, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, place in it and hash of the anchors of all documents that aren't skipped."""
    usable = np.where(skipped, 0, np.maximum(0, texts.length - MATCH + 1))
    total = int(texts.start[-1]) - MATCH
    edges = np.zeros(total + 1, dtype=np.int8)
    np.add.at(edges, texts.start[:-1] - MATCH, (usable > 0).astype(np.int8))
    np.add.at(edges, texts.start[:-1] - MATCH + usable, -(usable > 0).astype(np.int8))
    ok = np.cumsum(edges, dtype=np.int8)[:total] > 0
    flat, hashed = [], []
    for at in range(0, total, SLICE):
        part = ok[at : at + SLICE]
        if part.any():
            raw = texts.bytes[MATCH + at : MATCH + at + len(part) + MATCH + 8]
            places, h = anchors(raw, part)
            flat.append(places + at + MATCH)
            hashed.append(h)
    if not flat:
        return np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint64)
    flat, hashed = np.concatenate(flat), np.concatenate(hashed)
    flat, first = np.unique(flat, return_index=True)
    index = np.searchsorted(texts.start, flat, side="right") - 1
    return index.astype(np.uint32), (flat - texts.start[index]).astype(np.uint32), hashed[first]


# ---------------------------------------------------------------- deep-shallow sorting


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian eight-byte characters: three-way partitions character by character."""
    out, todo = [], [(np.arange(len(words)), 0)]
    depth_end = words.shape[1]
    while todo:
        rows, depth = todo.pop()
        if depth == depth_end or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= SMALL_SEGMENT:
            out.append(rows[np.lexsort([words[rows, d] for d in range(depth_end - 1, depth - 1, -1)])])
        else:
            characters = words[rows, depth]
            a, b, c = characters[[0, len(rows) // 2, -1]].tolist()
            pivot = np.uint64(max(min(a, b), min(max(a, b), c)))
            less, more = characters < pivot, characters > pivot
            todo += [(rows[more], depth), (rows[~less & ~more], depth + 1), (rows[less], depth)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


class BlindTrie:
    """A Patricia trie over strings of one length: branches know the depth at which strings part, not what lies between."""

    def __init__(self, size: int):
        self.size = size
        self.root: list | None = None  # a leaf is [string, members]; a branch is [depth, {byte: node}]

    def add(self, string: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = [string, [member]]
            return
        while not isinstance(node[0], bytes):  # blind descent to any leaf that agrees on the branching bytes
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        if node[0] == string:
            node[1].append(member)
            return
        parted = int.from_bytes(node[0]) ^ int.from_bytes(string)
        depth = self.size - (parted.bit_length() + 7) // 8
        other = node[0][depth]
        above, node = None, self.root
        while not isinstance(node[0], bytes) and node[0] < depth:
            above, node = node, node[1][string[node[0]]]
        if not isinstance(node[0], bytes) and node[0] == depth:
            node[1][string[depth]] = [string, [member]]
            return
        branch = [depth, {other: node, string[depth]: [string, [member]]}]
        if above is None:
            self.root = branch
        else:
            above[1][string[above[0]]] = branch

    def members(self) -> list[int]:
        """All members in the order of their strings."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if isinstance(node[0], bytes):
                out += node[1]
            else:
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(rows: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)[:, :SHALLOW_WORDS]
    order = multikey_quicksort(words)
    if width <= 8 * SHALLOW_WORDS or n < 2:
        return order
    sorted_words = words[order]
    together = np.all(sorted_words[1:] == sorted_words[:-1], axis=1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], together, [False]]).astype(np.int8)))
    deep = np.ascontiguousarray(rows[:, 8 * SHALLOW_WORDS :])
    size = deep.shape[1]
    raw = deep.tobytes()
    for first, last in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist()):
        trie = BlindTrie(size)
        for member in order[first:last].tolist():
            trie.add(raw[member * size : (member + 1) * size], member)
        order[first:last] = trie.members()
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefix of each row in the order with the one before it; 0 for the first."""
    differ = rows[order[1:]] != rows[order[:-1]]
    lengths = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], lengths])[: len(order)]


def covered(right: np.ndarray, left: np.ndarray, right_size: np.ndarray, left_size: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the fewest and most bytes before its anchor at which a window starts that a smaller document holds.

    Where there is none, the fewest is beyond the most.
    """
    n = len(doc_id)
    order_r, order_l = deep_shallow_order(right), deep_shallow_order(left)
    prefix_r, prefix_l = common_prefixes(right, order_r), common_prefixes(left, order_l)
    fewest, most = np.full(n, MATCH, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    identity_r, identity_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    rank = np.unique(doc_id, return_inverse=True)[1].astype(np.int64)
    for before in range(LEFT + 1):
        rows = np.flatnonzero((left_size >= before) & (right_size >= MATCH - before))
        if len(rows) < 2:
            continue
        identity_r[order_r] = np.cumsum(prefix_r < MATCH - before)
        identity_l[order_l] = np.cumsum(prefix_l < before)
        key = identity_l[rows] * (n + 1) + identity_r[rows]
        by = np.lexsort((rank[rows], key))
        key, ranks = key[by], rank[rows][by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        least = ranks[first][np.cumsum(first) - 1]
        found = rows[by[ranks > least]]
        fewest[found] = np.minimum(fewest[found], before)
        most[found] = before
    return fewest, most


# ---------------------------------------------------------------- the steps

#: Added to the source of a value that holds hot windows.
_HOT = 1 << 30
_BLOBS = "bucket int, source int, value binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table(
        {"bucket": pa.array([r[0] for r in rows], pa.int32()), "source": pa.array([r[1] for r in rows], pa.int32()), "value": pa.array([r[2] for r in rows], pa.binary())}
    )


def _split(target: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows of each target, in their order."""
    order = np.argsort(target, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(target[order]) != 0])) if len(order) else []
    return [(int(target[part[0]]), part) for part in np.split(order, firsts[1:])] if len(order) else []


class Anchors:
    """The anchors of a bucket's documents that aren't exact copies, and the distinct ones by the bucket that asks about them."""

    def __init__(self, texts: Texts, copies: list[tuple[int, int]], buckets: int):
        ids, tags = (np.array([c[k] for c in copies], dtype=np.int64) for k in (0, 1))
        self.index, self.place, h = bucket_anchors(texts, texts.marked(ids, tags))
        self.distinct, first, self.group = np.unique(h >> np.uint64(24), return_index=True, return_inverse=True)
        self.times = np.bincount(self.group, minlength=len(self.distinct))
        self.several = np.zeros(len(self.distinct), dtype=bool)
        self.several[self.group[self.index != self.index[first][self.group]]] = True
        self.parts = _split((self.distinct % np.uint64(buckets)).astype(np.int64))


def _copies(table: pa.Table) -> list[tuple[int, int]]:
    """The (doc_id, tag) pairs of exact copies among what came to a bucket."""
    return [(i, t) for i, t, v in zip(*(table.column(c).to_pylist() for c in ("doc_id", "tag", "value"))) if v is None]


def _step_anchors(buckets: int):
    """Texts and marks of exact copies -> the distinct anchors by hash, each with twice its occurrences, and 1 more if two documents here hold it."""

    def run(docs: pa.Table, copies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _blobs([])
        source, found = docs.column("bucket")[0].as_py(), Anchors(Texts(docs), _copies(copies), buckets)
        rows = []
        for bucket, at in found.parts:
            low = np.ascontiguousarray(found.distinct[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            rows.append((bucket, source, dump(low.reshape(-1), (2 * found.times[at] + found.several[at]).astype("<u4"))))
        return _blobs(rows)

    return run


def _step_shared(hot_anchor: int):
    """Anchors of one bucket -> to where they came from, in their order, whether two documents or more hold each and whether it is hot."""

    def run(part: pa.Table) -> pa.Table:
        asked, sources = part.column("bucket")[0].as_py(), part.column("source").to_pylist()
        tops, held = [], []
        for value in part.column("value").to_pylist():
            low, codes = load(value, "u1", "<u4")
            wide = np.zeros((len(codes), 8), dtype=np.uint8)
            wide[:, :5] = low.reshape(-1, 5)
            tops.append(wide.view("<u8").reshape(-1)), held.append(codes)
        _, group, buckets_with = np.unique(np.concatenate(tops), return_inverse=True, return_counts=True)
        codes = np.concatenate(held)
        shared = buckets_with > 1
        shared[group[codes % 2 == 1]] = True
        hot = np.bincount(group, weights=codes // 2) > hot_anchor
        cuts = np.cumsum([len(t) for t in tops])[:-1]
        parts = zip(sources, np.split(shared[group], cuts), np.split(hot[group], cuts))
        return _blobs([(source, asked, dump(np.packbits(a), np.packbits(b))) for source, a, b in parts])

    return run


def row_digests(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row of bytes."""
    width = rows.shape[1]
    a, b = np.zeros((2, len(rows)), dtype=np.uint64)
    for at in (*range(0, width - 8, 8), width - 8):
        word = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").reshape(-1)
        a, b = seed_hash(a, word), seed_hash(word, b ^ np.uint64(at + 1))
    return a, b


def window_digests(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the MATCH bytes at each start."""
    return row_digests(raw[starts[:, None] + _RIGHT])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, earlier rows first, and the number of each place's group in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    return order, np.cumsum(new)


def _known(doc_id: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows whose documents come by id: whether a smaller document has the same digest."""
    order, group = _groups(a, b)
    out = np.empty(len(order), dtype=bool)
    out[order] = doc_id[order] > doc_id[order][np.searchsorted(group, group)]
    return out


def hot_windows(texts: Texts, index: np.ndarray, place: np.ndarray):
    """Windows around hot anchors, in parts of bounded size: digests, document, start, and whether a smaller document here holds the same one."""
    first = np.maximum(0, place - LEFT)
    many = np.maximum(0, np.minimum(place, texts.length[index] - MATCH) - first + 1)
    edges = np.zeros(len(texts.bytes) + 1, dtype=np.int8)  # a window holds at most LEFT + 1 places
    np.add.at(edges, texts.start[index] + first, (many > 0).astype(np.int8))
    np.add.at(edges, texts.start[index] + first + many, -(many > 0).astype(np.int8))
    starts = np.flatnonzero(np.cumsum(edges, dtype=np.int8, out=edges))
    if not len(starts):
        return
    step = SLICE // 16
    a, b = map(np.concatenate, zip(*(window_digests(texts.bytes, starts[at : at + step]) for at in range(0, len(starts), step))))
    parts = np.uint64(1 + len(starts) // SLICE)
    for part in range(int(parts)):
        at = np.flatnonzero(a % parts == part)
        if len(at):
            i = np.searchsorted(texts.start, starts[at], side="right") - 1
            yield a[at], b[at], i, starts[at] - texts.start[i], _known(texts.doc_id[i], a[at], b[at])


def _contexts(texts: Texts, index: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each anchor: the bytes to the right, those to the left from its edge on, and how many there are of both."""
    flat = texts.start[index] + place
    right_size, left_size = np.minimum(MATCH, texts.length[index] - place), np.minimum(LEFT, place)
    right, left = texts.bytes[flat[:, None] + _RIGHT], texts.bytes[flat[:, None] - _BEFORE]
    right[_RIGHT >= right_size[:, None]] = 0
    left[_BEFORE > left_size[:, None]] = 0
    return np.concatenate([right, left, right_size[:, None].astype(np.uint8), left_size[:, None].astype(np.uint8)], axis=1)


def _step_contexts(buckets: int):
    """Texts, marks of exact copies and bits of anchors -> contexts and hot windows by hash; and spans that this task knows already."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _blobs([])
        source, texts = docs.column("bucket")[0].as_py(), Texts(docs)
        found = Anchors(texts, _copies(known), buckets)
        bits = {s: load(v, "u1", "u1") for s, v in zip(known.column("source").to_pylist(), known.column("value").to_pylist()) if v is not None}
        shared, hot = np.zeros((2, len(found.distinct)), dtype=bool)
        for bucket, at in found.parts:
            shared[at], hot[at] = (np.unpackbits(x, count=len(at)).astype(bool) for x in bits[bucket])
        rows, spans = [], [np.empty((0, 3), dtype=np.int64)]
        here = (shared & hot)[found.group]
        for a, b, i, start, known in hot_windows(texts, found.index[here].astype(np.int64), found.place[here].astype(np.int64)):
            spans.append(np.column_stack([i[known], start[known], start[known] + MATCH]))
            kept = np.flatnonzero(~known)
            for bucket, at in _split((a[kept] % np.uint64(buckets)).astype(np.int64)):
                at = kept[at]
                rows.append((bucket, _HOT + source, dump(a[at], b[at], texts.doc_id[i[at]], i[at].astype("<u4"), start[at].astype("<u4"))))
        here = (shared & ~hot)[found.group]
        index, place = found.index[here].astype(np.int64), found.place[here].astype(np.int64)
        slices = [slice(at, at + 50_000) for at in range(0, len(index), 50_000)]
        digests = [row_digests(_contexts(texts, index[at], place[at])) for at in slices]
        repeated = _known(texts.doc_id[index], *map(np.concatenate, zip(*digests))) if digests else None
        del digests
        for at in slices:
            i, p, again = index[at], place[at], repeated[at]
            whole = _contexts(texts, i, p)
            right, right_size, left_size = whole[:, :MATCH], whole[:, -2].astype(np.int64), whole[:, -1].astype(np.int64)
            known = again & (right_size + left_size >= MATCH)
            spans.append(np.column_stack([i[known], p[known] - left_size[known], p[known] + right_size[known]]))
            h = seed_hash(*(np.ascontiguousarray(right[:, s : s + 8]).view("<u8").reshape(-1) for s in (0, 8)))
            target = ((h >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            kept = np.flatnonzero(~again)
            for bucket, at in _split(target[kept]):
                at = kept[at]
                value = dump(whole[at].reshape(-1), texts.doc_id[i[at]], i[at].astype("<u4"), p[at].astype("<u4"))
                rows.append((bucket, source, value))
        known = np.concatenate(spans)
        if len(known):
            rows.append((source % buckets, -1 - source, dump(known[:, 0].astype("<u4"), known[:, 1].astype("<u4"), known[:, 2].astype("<u4"))))
        return _blobs(rows)

    return run


def _step_sorted(part: pa.Table) -> pa.Table:
    """Contexts and hot windows of one bucket -> spans to remove, by the documents' buckets; known spans pass through."""
    width = MATCH + LEFT + 2
    out, wholes, ids, indexes, places, sources, windows = [], [], [], [], [], [], []
    for source, value in sorted(zip(part.column("source").to_pylist(), part.column("value").to_pylist())):
        if source < 0:
            out.append((-1 - source, -1 - source, value))
            continue
        if source >= _HOT:
            windows.append([*load(value, "<u8", "<u8", "<i8", "<u4", "<u4")])
            windows[-1].append(np.full(len(windows[-1][0]), source - _HOT, dtype=np.int64))
            continue
        whole, doc_id, index, place = load(value, "u1", "<i8", "<u4", "<u4")
        wholes.append(whole.reshape(-1, width)), ids.append(doc_id), indexes.append(index), places.append(place)
        sources.append(np.full(len(place), source, dtype=np.int64))
    if wholes:
        whole, doc_id, index, place, sources = map(np.concatenate, (wholes, ids, indexes, places, sources))
        right, left = np.ascontiguousarray(whole[:, :MATCH]), np.ascontiguousarray(whole[:, MATCH : MATCH + LEFT])
        fewest, most = covered(right, left, whole[:, -2].astype(np.int64), whole[:, -1].astype(np.int64), doc_id)
        found = np.flatnonzero(most >= 0)
        start, end = place[found].astype(np.int64) - most[found], place[found].astype(np.int64) - fewest[found] + MATCH
        for source, at in _split(sources[found]):
            out.append((source, source, dump(index[found[at]], start[at].astype("<u4"), end[at].astype("<u4"))))
    if windows:
        a, b, doc_id, index, start, sources = map(np.concatenate, zip(*windows))
        order, group = _groups(a, b)
        least = np.minimum.reduceat(doc_id[order], np.flatnonzero(np.diff(group, prepend=-1)))
        found = order[doc_id[order] > least[group]]
        for source, at in _split(sources[found]):
            out.append((source, source, dump(index[found[at]], start[found[at]], start[found[at]] + np.uint32(MATCH))))
    return _blobs(out)


def removed_bytes(firsts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of so many bytes are in a span."""
    order = np.argsort(firsts, kind="stable")
    firsts, reach = firsts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(firsts), dtype=bool)
    new[1:] = firsts[1:] > reach[:-1]
    edges = np.zeros(size + 1, dtype=np.int8)  # spans are apart once they are merged
    edges[firsts[new]] = 1
    edges[reach[np.roll(new, -1)]] = -1
    return np.cumsum(edges, dtype=np.int8, out=edges).view(bool)


def _step_cut(as_text: bool, carried: list[str]):
    """Texts and spans -> what is left of each document, with the columns that it carries."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        texts = Texts(docs)
        firsts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        copies = _copies(spans)
        if copies:
            marked = texts.marked(np.array([c[0] for c in copies]), np.array([c[1] for c in copies])) & (texts.length >= MATCH)
            firsts.append(texts.start[:-1][marked]), ends.append(texts.start[1:][marked])
        for value in spans.column("value").to_pylist():
            if value is not None:
                index, start, end = load(value, "<u4", "<u4", "<u4")
                firsts.append(texts.start[index] + start), ends.append(texts.start[index] + end)
        gone = removed_bytes(np.concatenate(firsts), np.concatenate(ends), len(texts.bytes))
        rows = []
        for i, n, at in zip(texts.doc_id.tolist(), texts.length.tolist(), texts.start.tolist()):
            away = gone[at : at + n]
            removed = int(away.sum())
            kept = (texts.bytes[at : at + n][~away] if removed else texts.bytes[at : at + n]).tobytes()
            runs = int(away[0]) + int(np.count_nonzero(away[1:] & ~away[:-1])) if removed else 0
            rows.append((i, n, removed, runs, kept.decode("utf-8", "ignore") if as_text else kept))
        kinds = [*_CUT, ("kept", pa.string() if as_text else pa.binary())]
        out = pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})
        for name in carried:
            out = out.append_column(name, texts.table.column(name))
        return out

    return run


_CUT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
#: The id that a null doc_id has inside: smaller than any other.
_NULL_ID = -(1 << 63)


def remove_repeats(docs: DataFrame, rules: SuffixRules = SuffixRules(), as_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of `docs` (doc_id, text).

    With as_text, `kept` is text, without what is left of characters that a cut goes through. Columns named in `carry`
    come along.

    A null text is an empty one. Rows with equal ids never count as smaller than each other, so exact repeats of a row
    lose the same bytes; a null id is smaller than any other. Texts under MATCH bytes lose nothing. Other columns are
    ignored; an empty table gives an empty result. Texts are read whole, whatever their length.
    """
    spark = docs.sparkSession
    ship(spark)
    size = input_bytes(docs)
    if size >= 1 << 50:  # Spark doesn't know, or it is that large
        size = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    buckets = max(shuffle_partitions(spark), -(-2 * size // rules.bucket_bytes))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    dealt = tagged.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(buckets)).cast("int"))
    # Exact copies: of each text, by a strong digest, all but the smallest id.
    digests = materialize(tagged.select("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("digest")))
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    groups = materialize(groups.where("least < most").drop("most"))
    # At most hot_groups groups can hold over 1 / hot_groups of all rows: the table that is broadcast is bounded.
    hot = F.col("n") > max(rules.hot_copies, digests.count() // rules.hot_groups)
    large = F.broadcast(groups.where(hot))
    several = digests.join(large, "digest").unionByName(digests.join(large, "digest", "left_anti").join(groups.where(~hot), "digest"))
    copies = several.where("doc_id > least").select("doc_id", "tag").distinct()
    copies = materialize(copies.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(buckets)).cast("int")))
    texts = dealt.groupBy("bucket")
    none = F.lit(None)
    marks = copies.select("bucket", none.cast("int").alias("source"), "doc_id", "tag", none.cast("binary").alias("value"))
    beside = lambda blobs: blobs.select("bucket", "source", none.cast("long").alias("doc_id"), none.cast("long").alias("tag"), "value").unionByName(marks).groupBy("bucket")
    found = texts.cogroup(marks.groupBy("bucket")).applyInArrow(_step_anchors(buckets), _BLOBS)
    shared = found.groupBy("bucket").applyInArrow(_step_shared(rules.hot_anchor), _BLOBS)
    contexts = texts.cogroup(beside(shared)).applyInArrow(_step_contexts(buckets), _BLOBS)
    spans = contexts.groupBy("bucket").applyInArrow(_step_sorted, _BLOBS)
    inner = [f"carried_{k}" for k in range(len(carry))]
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    schema += "".join(f", {name} {docs.schema[c].dataType.simpleString()}" for name, c in zip(inner, carry))
    out = texts.cogroup(beside(spans)).applyInArrow(_step_cut(as_text, inner), schema)
    doc_id = F.when(F.col("doc_id") == _NULL_ID, None).otherwise(F.col("doc_id")).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept", *(F.col(n).alias(c) for n, c in zip(inner, carry)))
