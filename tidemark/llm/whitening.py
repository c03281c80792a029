"""Whitening of embeddings from an exact integer scatter.

Entries become whole numbers x. Tasks subtract a fixed shift and add up arbitrary-precision sums and cross-products: each
entry is cut into digits of 20 bits, so that products of digits added over a block of rows are exact in doubles, and blocks
are put together in Python's integers. Spark adds the tasks' numbers, again cut into digits, as decimals. The driver forms
n * X'X - S S' without any rounding, whatever the offset of the entries, and only then converts to float and decomposes.
What reaches the driver are a few numbers for each pair of dimensions; vectors stay in their tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, map_arrow

#: Fixed values of the contract: x = floor(SCALE * c) + OFFSET, and the number of components.
SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Bits of a digit in a task, and rows of a block: products of digits add up to less than 2 ** 53.
DIGIT = 20
BLOCK = 4096
#: Bits of a digit in the numbers that tasks hand to Spark: sums over 2 ** 60 tasks fit in 38 decimals.
HANDED = 60


@dataclass(frozen=True)
class Scatter:
    """n rows, their exact sums (of x - OFFSET) and n * X'X - S S', as Python integers."""

    n: int
    sums: list[int]
    scatter: list[list[int]]


@dataclass(frozen=True)
class Whitener:
    """What tasks need for each row: n, the exact sums, and the components with their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part: no null vector, no null or non-finite entry.

    Empty vectors, and vectors with an entry whose x no long can hold, take no part either.
    """
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    limit = F.lit(float(1 << 52))  # 2 ** 52 * SCALE is 2 ** 62; comparisons with NaN and infinity fail below as well
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit))
    return wide.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def _shifted(part: pa.RecordBatch, dims: int | None = None):
    """For each length of vectors (or only `dims`), their places in the batch and x - OFFSET as a matrix of longs."""
    array = part.column(part.schema.get_field_index("embedding"))
    sizes = np.asarray(array.value_lengths())
    flat, starts = array.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for d in np.unique(sizes) if dims is None else [dims]:
        at = np.flatnonzero(sizes == d)
        if len(at):
            yield int(d), at, np.floor(SCALE * flat[starts[at][:, None] + np.arange(d)]).astype(np.int64)


def _digits(x: np.ndarray) -> list[np.ndarray]:
    """Signed digits of DIGIT bits, lowest first, as doubles; as many as the largest entry needs."""
    sign, rest, out = np.sign(x), np.abs(x), []
    while True:
        out.append((sign * (rest & ((1 << DIGIT) - 1))).astype(np.float64))
        rest = rest >> DIGIT
        if not rest.any():
            return out


class Products:
    """X'X of matrices of longs added one after the other, exact: doubles within a block, longs over blocks, then Python integers."""

    def __init__(self, d: int):
        self.total = np.zeros((d, d), dtype=object)
        self.levels: dict[int, np.ndarray] = {}
        self.added = 0

    def add(self, x: np.ndarray) -> None:
        for first in range(0, len(x), BLOCK):
            digits = _digits(x[first : first + BLOCK])
            for i, a in enumerate(digits):
                for j, b in enumerate(digits):
                    found = (a.T @ b).astype(np.int64)
                    self.levels[i + j] = self.levels[i + j] + found if i + j in self.levels else found
                    self.added += 1
            if self.added >= 1000:  # of less than 2 ** 52 each
                self.flush()

    def flush(self) -> np.ndarray:
        for level, found in self.levels.items():
            self.total = self.total + (found.astype(object) << (DIGIT * level))
        self.levels, self.added = {}, 0
        return self.total


def _handed(d: int, n: int, sums: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
    """A task's numbers as rows (d, i, j, place, value): the count at (-1, -1), sums at (i, -1), products at (i, j) for j <= i."""
    low, high = np.tril_indices(d)[1], np.tril_indices(d)[0]
    i = np.concatenate([[-1], np.arange(d), high])
    j = np.concatenate([[-1], np.full(d, -1), low])
    rest = np.concatenate([np.array([n], dtype=object), sums, products[high, low]])
    sign = np.where(rest < 0, -1, 1).astype(object)
    rest, place, out = np.abs(rest), 0, []
    while True:
        out.append(((rest % (1 << HANDED)) * sign).astype(np.int64))
        rest = rest >> HANDED
        place += 1
        if not (rest > 0).any():
            break
    rows = len(i)
    return batch(
        d=pa.array(np.full(rows * place, d, dtype=np.int32)),
        i=pa.array(np.tile(i, place).astype(np.int32)),
        j=pa.array(np.tile(j, place).astype(np.int32)),
        place=pa.array(np.repeat(np.arange(place, dtype=np.int32), rows)),
        value=pa.array(np.concatenate(out)),
    )


def scatter(vectors: DataFrame) -> Scatter | None:
    """The exact scatter of the usable vectors of the most common length (ties: the smaller); None if there are none.

    Each task hands on about d * d / 2 numbers, whatever its rows; the driver gets that many sums of them.
    """

    def run(batches):
        held = {}
        for part in batches:
            for d, _, x in _shifted(part):
                n, sums, products = held.get(d, (0, np.zeros(d, dtype=object), None))
                products = products or Products(d)
                products.add(x)
                added = sum((digit.sum(axis=0).astype(np.int64).astype(object) << (DIGIT * k) for k, digit in enumerate(_digits(x))), np.zeros(d, dtype=object))
                held[d] = n + len(x), sums + added, products
        for d, (n, sums, products) in held.items():
            yield _handed(d, n, sums, products.flush())

    rows = map_arrow(vectors.select("embedding"), run, "d int, i int, j int, place int, value long")
    added = rows.groupBy("d", "i", "j", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    added = added.persist()  # read twice: the length is chosen before the numbers come to the driver
    try:
        most = added.where("i = -1").orderBy(F.desc("value"), "d").first()
        if most is None:
            return None
        d, n = most.d, int(most.value)
        found = added.where(F.col("d") == d).select("i", "j", "place", "value").toArrow()
    finally:
        added.unpersist()
    sums, products = [0] * d, [[0] * d for _ in range(d)]
    for i, j, place, value in zip(*(found.column(c).to_pylist() for c in ("i", "j", "place", "value"))):
        if i < 0:
            continue
        if j < 0:
            sums[i] += int(value) << (HANDED * place)
        else:
            products[i][j] += int(value) << (HANDED * place)
    whole = [[n * products[max(i, j)][min(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return Scatter(n, sums, whole)


def decompose(found: Scatter, components: int = COMPONENTS) -> Whitener:
    """Eigenvalues and unit eigenvectors of the scatter over n * n, largest first; the largest entry of each is positive.

    Components beyond the numerical rank get eigenvalue zero.
    """
    square = found.n * found.n
    covariance = np.array([[entry / square for entry in row] for row in found.scatter])  # whole numbers divided once, rightly rounded
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    floor = len(covariance) * np.finfo(np.float64).eps * max(float(values[0]), 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = sum(row[i] for i, row in enumerate(found.scatter)) / square
    return Whitener(found.n, found.sums, vectors, np.where(values > floor, values, 0.0), trace)


def _rows(vectors: DataFrame, fitted: Whitener) -> DataFrame:
    """vec_id, the exact deviation (a decimal) and the whitened components (an array; null entries beyond the rank) of each row."""
    n, d = fitted.n, len(fitted.sums)
    least = min(fitted.sums), max(fitted.sums)
    scale = np.where(fitted.values > 0, 1 / np.sqrt(np.where(fitted.values > 0, fitted.values, 1.0)), np.nan)
    projection = fitted.vectors * scale

    def run(batches):
        for part in batches:
            for _, at, x in _shifted(part, d):
                widest = max(abs(n * int(b) - s) for b in (x.min(), x.max()) for s in least)
                if widest * widest * d < 1 << 63:
                    away = n * x - np.array(fitted.sums, dtype=np.int64)
                    deviation = (away * away).sum(axis=1).tolist()
                else:
                    away = n * x.astype(object) - np.array(fitted.sums, dtype=object)
                    deviation = (away * away).sum(axis=1).tolist()
                whitened = (away / n).astype(np.float64) @ projection
                kinds = pa.array(whitened.ravel(), from_pandas=True)  # not a number becomes null
                offsets = np.arange(0, whitened.size + 1, whitened.shape[1], dtype=np.int32)
                yield batch(
                    vec_id=part.column(part.schema.get_field_index("vec_id")).take(pa.array(at)),
                    deviation=pa.array([str(v) for v in deviation]),
                    whitened=pa.ListArray.from_arrays(pa.array(offsets), kinds),
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return map_arrow(vectors, run, f"vec_id {kind}, deviation string, whitened array<double>")


def identity_error(rows: DataFrame, fitted: Whitener) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from the rows; null components are left out.

    Rows are centred already (by the exact means, before anything is multiplied); the rest of their mean is taken off.
    """
    kept = [k for k, value in enumerate(fitted.values) if value > 0]
    if not kept:
        return None
    w = [F.col("whitened")[k] for k in kept]
    pairs = [(a, b) for a in range(len(kept)) for b in range(a + 1)]
    sums = [F.avg(v).alias(f"m{a}") for a, v in enumerate(w)] + [F.avg(w[a] * w[b]).alias(f"p{a}_{b}") for a, b in pairs]
    got = rows.agg(*sums).first()
    return max(abs(got[f"p{a}_{b}"] - got[f"m{a}"] * got[f"m{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) for each usable vector of
    `vectors` (vec_id, embedding) and each of its leading components (fewer, if vectors are shorter).

    Rows whose vector is null, empty or holds null or non-finite entries take no part, nor do vectors of another length than
    the most common one, nor such with an entry of 2 ** 52 or more. Repeated rows all count; a null id stays null; other columns
    are ignored. Components beyond the rank (all, if there is one vector) have a null `whitened`; `explained` is null if nothing
    varies. `deviation` is null where no long can hold the exact number; `deviation_exact` (text) always has it. Signs are those of
    the largest entry. An empty table gives an empty result.
    """
    wide = usable(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    found = scatter(wide)
    if found is None:
        return wide.sparkSession.createDataFrame([], schema)
    fitted = decompose(found, components)
    rows = _rows(wide, fitted)
    error = identity_error(rows, fitted)
    share = F.array(*[F.lit(float(v / fitted.trace) if fitted.trace > 0 else None).cast("double") for v in fitted.values])
    unfolded = rows.select("vec_id", F.col("deviation").alias("deviation_exact"), F.posexplode("whitened").alias("k", "whitened"))
    return unfolded.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        F.col("deviation_exact").try_cast("long").alias("deviation"),
        "whitened",
        F.get(share, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_exact",
    )
