"""Nearest neighbours by inner product, over low-dimensional stable projections indexed by kd-trees.

Largest inner product becomes smallest distance: vectors get one more coordinate that brings them all to the largest
norm, and queries are scaled to it. Gaussian (2-stable) projections to a few dimensions keep distances in this sense: a
point at distance d is projected to a distance whose square over d squared has a chi-square distribution. So projected
neighbours are verified leaf by leaf, and a point only if its own projected distance passes the chi-square test against the
k-th neighbour found so far; the search stops once anything nearer would, with the wanted probability, have been seen.

The projected space is cut by a kd-tree that is fitted to a bounded sample; every row is indexed, in the cell it falls in.
Each cell builds its own kd-tree. A query visits its home cell first, and then, by the same chi-square test
against what it found there, the cells that are near enough. A cell that outgrows its size is salted into parts, and
queries come in blocks, so that no task holds all of either. Equal vectors are one point that keeps its smallest ids.

How much is verified depends on the data: among vectors without any structure in 64 dimensions, whose 20th neighbour is not much
nearer than a random one, the test passes 58 % of 2,000 and 38 % of 50,000 vectors, and fewer the more there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow
from tidemark.session import materialize, ship


@dataclass(frozen=True)
class AnnRules:
    """Neighbours wanted, projected dimensions (an even number), the probability of the stopping test, and sizes."""

    neighbours: int = 20
    query_every: int = 20
    dimensions: int = 16
    certainty: float = 0.9
    cell_rows: int = 8_192
    leaf_rows: int = 256
    sample_rows: int = 100_000
    query_block: int = 2_048
    group_queries: int = 200_000
    seed: int = 11


def chi_square_quantile(certainty: float, dimensions: int) -> float:
    """The quantile of the chi-square distribution with an even number of degrees of freedom, by bisection."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, dimensions // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 1.0
    while below(high) < certainty:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < certainty else (low, middle)
    return high


@dataclass(frozen=True)
class Projection:
    """The lift to equal norms and the Gaussian projection."""

    width: int
    norm: float
    dimensions: int
    seed: int

    def _matrix(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.width + 1, self.dimensions))

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest]) @ self._matrix()

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Projected queries, scaled to the common norm; their last coordinate is zero."""
        return self.scaled(q) @ self._matrix()[:-1]

    def scaled(self, q: np.ndarray) -> np.ndarray:
        return q * (self.norm / np.sqrt(np.einsum("ij,ij->i", q, q)))[:, None]


class Cells:
    """A kd-tree over a sample as a list of boxes: each cell's lower and upper corner."""

    def __init__(self, sample: np.ndarray, cells: int):
        low, high = np.full(sample.shape[1], -np.inf), np.full(sample.shape[1], np.inf)
        self.nodes: list[tuple] = []  # (dimension, cut, left, right), or (None, cell, -1, -1)
        boxes: list[tuple[np.ndarray, np.ndarray]] = []

        def grow(rows: np.ndarray, wanted: int, low: np.ndarray, high: np.ndarray) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            spread = sample[rows].max(axis=0) - sample[rows].min(axis=0) if len(rows) > 1 else np.zeros(len(low))
            k = int(np.argmax(spread))
            if wanted < 2 or spread[k] == 0:
                self.nodes[at] = (None, len(boxes), -1, -1)
                boxes.append((low, high))
                return at
            cut = float(np.median(sample[rows, k]))
            left = sample[rows, k] < cut
            if not left.any():
                cut = float(np.min(sample[rows, k][sample[rows, k] > cut]))
                left = sample[rows, k] < cut
            high_left, low_right = high.copy(), low.copy()
            high_left[k] = low_right[k] = cut
            self.nodes[at] = (k, cut, grow(rows[left], wanted // 2, low, high_left), grow(rows[~left], wanted - wanted // 2, low_right, high))
            return at

        grow(np.arange(len(sample)), cells, low, high)
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out, todo = np.empty(len(points), dtype=np.int32), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            k, cut, left, right = self.nodes[node]
            if k is None:
                out[rows] = cut
            else:
                below = points[rows, k] < cut
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        return box_distances(points, self.low, self.high)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        gap = np.maximum(low[:, k] - points[:, k, None], points[:, k, None] - high[:, k])
        out += np.maximum(gap, 0.0) ** 2
    return out


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """The leaves of a kd-tree: rows split at the median of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        k = int(np.argmax(points[rows].max(axis=0) - points[rows].min(axis=0)))
        order = np.argpartition(points[rows, k], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def search_cell(x: np.ndarray, points: np.ndarray, q: np.ndarray, projected: np.ndarray, bound: np.ndarray, kept: int, norm: float, limit: float, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each query, rows and inner products of the best `kept` points, and the number of pairs that were verified.

    q is scaled to the common norm; bound has the squared distance of the k-th neighbour already known (or infinity).
    """
    leaves = _leaves(points, leaf_rows)
    low, high = np.array([points[r].min(axis=0) for r in leaves]), np.array([points[r].max(axis=0) for r in leaves])
    near = box_distances(projected, low, high)
    order = np.argsort(near, axis=1, kind="stable")
    best = np.full((len(q), kept), -np.inf)
    rows = np.full((len(q), kept), -1, dtype=np.int64)
    active, verified = np.arange(len(q)), 0
    for turn in range(len(leaves)):
        leaf = order[active, turn]
        reach = limit * np.maximum(np.minimum(bound[active], 2 * norm**2 - 2 * best[active].min(axis=1)), 0.0)
        going = near[active, leaf] <= reach
        active, leaf, reach = active[going], leaf[going], reach[going]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            who, members = active[part], leaves[leaf[part[0]]]
            a, b = projected[who], points[members]
            gap = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
            passed, point = np.nonzero(gap <= reach[part, None] * (1 + 1e-9))
            verified += len(passed)
            products = np.full(gap.shape, -np.inf)
            products[passed, point] = np.einsum("ij,ij->i", q[who[passed]], x[members[point]])
            all_best = np.concatenate([best[who], products], axis=1)
            all_rows = np.concatenate([rows[who], np.broadcast_to(members, (len(who), len(members)))], axis=1)
            top = np.argpartition(-all_best, kept - 1, axis=1)[:, :kept]
            best[who], rows[who] = np.take_along_axis(all_best, top, axis=1), np.take_along_axis(all_rows, top, axis=1)
    return np.where(np.isfinite(best), rows, -1), best, verified


def _matrix(values: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def _expand(rep: np.ndarray, ids: list[list[int]], x: np.ndarray, q: np.ndarray, rows: np.ndarray, kept: int):
    """Of each query, the ids and inner products of its best rows: products summed alike for equal vectors, ties to smaller ids."""
    for query, found in zip(q, rows):
        found = found[found >= 0]
        scores = (x[found] * query).sum(axis=1)
        pairs = sorted((-s, i) for s, r in zip(scores.tolist(), found.tolist()) for i in ids[r])
        yield [i for _, i in pairs[:kept]], [-s for s, _ in pairs[:kept]]


def _search(projection: Projection, rules: AnnRules, limit: float):
    """Search one cell for the queries that came to it."""
    kept, width = rules.neighbours + 1, projection.width

    def run(cell: pa.Table, queries: pa.Table) -> pa.Table:
        found_rep, found_ids, found_scores = [], [], []
        if cell.num_rows and queries.num_rows:
            x, ids = _matrix(cell.column("embedding"), width), cell.column("ids").to_pylist()
            points = projection.points(x)
            for at in range(0, queries.num_rows, rules.query_block):
                block = queries.slice(at, rules.query_block)
                q = _matrix(block.column("embedding"), width)
                bound = block.column("bound").to_numpy().astype(np.float64)
                rows, _, _ = search_cell(x, points, projection.scaled(q), projection.queries(q), bound, kept, projection.norm, limit, rules.leaf_rows)
                found_rep += block.column("rep").to_pylist()
                for best, scores in _expand(cell.column("rep").to_numpy(), ids, x, q, rows, kept):
                    found_ids.append(best), found_scores.append(scores)
        return pa.table({"rep": pa.array(found_rep, pa.int64()), "vec_ids": pa.array(found_ids, pa.list_(pa.int64())), "scores": pa.array(found_scores, pa.list_(pa.float64()))})

    return run


def _place(projection: Projection, cells: Cells):
    def run(batches):
        for part in batches:
            x = _matrix(part.column(part.schema.get_field_index("embedding")), projection.width)
            cell = cells.of(projection.points(x))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *part.columns], names=["cell", *part.schema.names])

    return run


def _route(projection: Projection, cells: Cells, limit: float, home: bool, salts: np.ndarray):
    """Send queries to the cell they fall in, or to all others near enough for the bound that they bring; to each part of a cell."""

    def run(batches):
        for part in batches:
            q = _matrix(part.column(part.schema.get_field_index("embedding")), projection.width)
            near = cells.distances(projection.queries(q))
            own = np.argmin(near, axis=1)
            if home:
                who, cell = np.arange(len(q)), own
            else:
                bound = part.column(part.schema.get_field_index("bound")).to_numpy().astype(np.float64)
                going = near <= limit * np.maximum(bound, 0.0)[:, None]
                going[np.arange(len(q)), own] = False
                who, cell = np.nonzero(going)
            times = salts[cell]
            who, cell = np.repeat(who, times), np.repeat(cell, times)
            salt = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, max(1, len(who)), 4096):
                cut = slice(at, at + 4096)
                some = part.take(pa.array(who[cut]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[cut].astype(np.int32)), pa.array(salt[cut].astype(np.int32)), *some.columns], names=["cell", "salt", *part.schema.names])

    return run


def nearest(vectors: DataFrame, rules: AnnRules = AnnRules()) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest found of each row whose vec_id is divisible by query_every.

    Vectors that are null, zero or hold null or non-finite components, or whose length isn't the most common one,
    take no part; neither do rows without an id. Repeated ids are rows of their own, but a query never meets its
    own id. Ties go to the smaller vec_id. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept, schema = rules.neighbours + 1, "rep long, vec_ids array<long>, scores array<double>"
    usable = F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & usable)
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    rows = rows.where(F.size("embedding") == widths[0].width)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= kept).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    flags = rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.max((F.col("vec_id") % rules.query_every == 0).cast("int")).alias("asked"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    distinct = materialize(few.select("ids", "embedding", F.element_at("ids", 1).alias("rep")).join(flags.select("rep", "asked"), "rep").withColumn("square", square))
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).first()
    projection = Projection(widths[0].width, math.sqrt(facts.square), rules.dimensions, rules.seed)
    limit = chi_square_quantile(rules.certainty, rules.dimensions)
    share = min(1.0, rules.sample_rows / facts.n)
    sample = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(share * 1_000_000)).select("embedding").limit(rules.sample_rows).toArrow()
    cells = Cells(projection.points(_matrix(sample.column("embedding"), projection.width)), max(1, min(facts.n // rules.cell_rows, sample.num_rows // 16)))
    placed = materialize(map_arrow(distinct.select("rep", "ids", "embedding"), _place(projection, cells), "cell int, rep long, ids array<long>, embedding array<double>"))
    # Cells are bounded in number by the sample; those that outgrow their size are salted, and each part meets each block of queries.
    salts = np.ones(len(cells.low), dtype=np.int64)
    for r in placed.groupBy("cell").count().collect():
        salts[r.cell] = -(-r["count"] // (4 * rules.cell_rows))
    queries = distinct.where("asked = 1").select("rep", "embedding", F.lit(float("inf")).alias("bound"))
    blocks = max(1, -(-queries.count() // rules.group_queries))
    parts = F.element_at(F.array(*map(F.lit, salts.tolist())), F.col("cell") + 1)
    spread = placed.withColumn("salt", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by_cell = spread.groupBy("cell", "salt", "block")
    routed = "cell int, salt int, rep long, embedding array<double>, bound double"

    def sent(asked: DataFrame, home: bool):
        out = map_arrow(asked, _route(projection, cells, limit, home, salts), routed)
        return out.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("cell", "salt", "block")

    found = materialize(by_cell.cogroup(sent(queries, True)).applyInArrow(_search(projection, rules, limit), schema))
    # The k-th product found at home bounds the distance of anything still wanted (its scale is the query's).
    at_home = found.select("rep", F.explode("scores").alias("score"))
    nth = Window.partitionBy("rep").orderBy(F.desc("score"))
    kth = at_home.withColumn("n", F.row_number().over(nth)).where(F.col("n") == kept).select("rep", F.col("score").alias("kth"))
    reach = F.lit(2 * facts.square) - 2 * F.col("kth") * math.sqrt(facts.square) / F.sqrt("square")
    bounded = distinct.where("asked = 1").join(kth, "rep", "left").select("rep", "embedding", F.coalesce(reach, F.lit(float("inf"))).alias("bound"))
    more = by_cell.cogroup(sent(bounded, False)).applyInArrow(_search(projection, rules, limit), schema)
    pairs = found.unionByName(more).select("rep", F.explode(F.arrays_zip("vec_ids", "scores")).alias("p")).select("rep", F.col("p.vec_ids").alias("vec_id"), F.col("p.scores").alias("score"))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    top = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= kept).drop("n")
    asked = rows.where(F.col("vec_id") % rules.query_every == 0).join(flags.where("asked = 1").select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), "rep")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.distinct().join(top, "rep").where("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= rules.neighbours).select("query_id", "rank", "vec_id", "score")
