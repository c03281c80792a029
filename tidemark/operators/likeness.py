"""The most similar name of a block for each name of another, by edit distance, without listing pairs.

Names of one side are walked in order, so that what begins alike is compared once; each step adds one letter to the edit distances of
all names of the other side at a time. Memory is bounded by the block and :data:`STATE_BYTES`.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes that a tile's distances and places of letters may take; a tile holds one left name at least.
STATE_BYTES = 1 << 26
#: Letters whose places in a tile's names are held at once.
LETTERS = 128
#: Names of a tile under which a running minimum takes one call, not one for each letter.
NARROW = 256


def _names(column: pa.ChunkedArray) -> list[str]:
    return [b.decode("utf-8", "surrogateescape") for b in column.cast(pa.binary()).to_pylist()]


def _rounded(gap: np.ndarray) -> np.ndarray:
    """To nine decimals as Spark rounds: halves of the decimal text go up."""
    scaled = gap * 1e9
    out = np.floor(scaled + 0.5) / 1e9
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) <= scaled * 1e-15):
        out[i] = float(Decimal(repr(float(gap[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _common(a: str, b: str) -> int:
    """How many letters two names share at their beginning."""
    at, most = 0, min(len(a), len(b))
    while at < most and a[at] == b[at]:
        at += 1
    return at


def distances(names: list[str], others: list[str]):
    """Yields the edit distances of each of `others`, which are sorted, to all of `names`.

    A state holds a row for each letter of the names, which end in its last row: the distance of each name up to there, less the letters
    up to there, so that an insertion is a running minimum. Rows before a name's first letter cost as much as no letter.
    """
    lengths = np.array([len(n) for n in names])
    deep, wide = int(lengths.max()), len(names)
    kind = np.int16 if deep + max(map(len, others)) < 2**15 else np.int32
    codes = np.array([n.rjust(max(deep, 1), "\0") for n in names]).view(np.uint32).reshape(wide, -1).T[:deep]
    before = np.arange(deep)[:, None] < deep - lengths
    equal, state, step = {}, [np.zeros((deep + 1, wide), kind)], np.empty((deep, wide), kind)
    shown = ""
    for name in others:
        for at in range(_common(shown, name), len(name)):
            letter = name[at]
            if letter not in equal:
                if len(equal) == LETTERS:
                    equal.clear()
                equal[letter] = np.where(before, -1, codes == ord(letter)).astype(kind)
            if len(state) < at + 2:
                state.append(np.empty((deep + 1, wide), kind))
            last, new = state[at], state[at + 1]
            new[0] = at + 1
            np.subtract(last[:-1], equal[letter], out=new[1:])
            np.add(last[1:], 1, out=step)
            np.minimum(new[1:], step, out=new[1:])
            if wide < NARROW:
                np.minimum.accumulate(new, axis=0, out=new)
            else:
                for i in range(deep):
                    np.minimum(new[i + 1], new[i], out=new[i + 1])
        shown = name
        yield state[len(name)][-1] + lengths


def most_similar(ratio: float, least: float, schema: T.StructType):
    """A function over one block of distinct left rows (_ls, _ln) and right ones (_rs, _rn, _r with the id), sizes and names.

    Gives each left row's best: the most similar name, then the smaller ratio of the sizes to nine decimals, then the smaller id; of
    those within the ratio and at least so similar.
    """

    def tile(sizes: np.ndarray, names: list[str], rights: list[tuple[str, float, int]]) -> tuple[np.ndarray, ...]:
        lengths = np.array([len(n) for n in names])
        best, gap, found = np.full(len(names), float(least)), np.full(len(names), np.inf), np.full(len(names), np.iinfo(np.int64).max)
        held = np.array([r[1] for r in rights])
        lows = np.searchsorted(sizes, held / ratio * (1 - 1e-9)).tolist()
        highs = np.searchsorted(sizes, held * ratio * (1 + 1e-9), side="right").tolist()
        partners = zip(rights, lows, highs)
        grouped = [(name, list(rows)) for name, rows in groupby(partners, key=lambda r: r[0][0])]
        for (name, rows), edits in zip(grouped, distances(names, [g[0] for g in grouped])):
            alike = 1 - edits / np.maximum(lengths, max(len(name), 1))
            for (_, size, place), low, high in rows:
                rise = (alike[low:high] >= best[low:high]).nonzero()[0] + low
                apart = np.maximum(sizes[rise] / size, size / sizes[rise])
                rise, apart = rise[apart <= ratio], _rounded(apart[apart <= ratio])
                better = (alike[rise] > best[rise]) | (apart < gap[rise]) | ((apart == gap[rise]) & (place < found[rise]))
                rise = rise[better]
                best[rise], gap[rise], found[rise] = alike[rise], apart[better], place
        return best, gap, found

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return to_arrow_schema(schema).empty_table()
        sizes = left.column("_ls").cast(pa.float64()).to_numpy()
        order = np.argsort(sizes, kind="stable")
        sizes, names = sizes[order], _names(left.column("_ln"))
        names = [names[i] for i in order]
        ids = pc.struct_field(right.column("_r"), [0])
        by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        places = np.empty(len(by_id), np.int64)
        places[by_id] = np.arange(len(by_id))
        rights = sorted(zip(_names(right.column("_rn")), right.column("_rs").cast(pa.float64()).to_pylist(), places.tolist()))
        cells = 2 * (max(map(len, names)) + 1) * (max(len(r[0]) for r in rights) + 1 + LETTERS)
        wide = min(max(STATE_BYTES // cells, 1), len(names))
        tiles = [tile(sizes[at : at + wide], names[at : at + wide], rights) for at in range(0, len(names), wide)]
        best, gap, found = (np.concatenate(part) for part in zip(*tiles))
        kept = np.flatnonzero(gap < np.inf)
        rows = pa.array(order[kept])
        columns = [left.column("_ls").take(rows), left.column("_ln").take(rows), pa.array(-best[kept]), pa.array(gap[kept]), ids.take(pa.array(by_id[found[kept]]))]
        return pa.Table.from_arrays(columns, names=schema.names).cast(to_arrow_schema(schema))

    return run
