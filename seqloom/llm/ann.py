"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square stop.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance, and
projected on a few Gaussian directions; the squared projected distance of two vectors over their squared
distance then follows a chi-square law. The top of a kd-tree over the projections, fitted on a bounded
sample, cuts the space into cells of a bounded mean size; each cell has a kd-tree of its own. A query
takes leaves in the order of their projected distance, and in a leaf the points within the stopping distance:
beyond it, a neighbour nearer than the k-th found would lie only with the probability 1 - ``CONFIDENCE``. These
are verified on the original coordinates, and the distance shrinks as nearer ones are found, until no leaf is
within it. A query first searches its own cell; the k-th distance found there then tells which other cells it
must visit.

Equal vectors are one point with their ``k + 1`` smallest ids, which is all that an answer can need, so a
frequent vector does not swell its cell. Queries are dealt in blocks; no task holds all of them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros; ties go to the smaller id; fewer than ``k`` candidates give
fewer rows; rows of one id count once, with the smallest of their vectors; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize

DIRECTIONS = 32  # an even number, for the closed form of the chi-square law
CONFIDENCE = 0.9  # by measured recall, see README
CELL_POINTS = 8_192  # mean number of distinct vectors of a cell
LEAF_POINTS = 1_024
SAMPLE_POINTS = 20_000  # bound of the vectors on which the top of the tree is fitted
QUERY_BLOCK = 4_096  # mean number of queries that visit a cell in one task


def chi_square_quantile(p: float, m: int = DIRECTIONS) -> float:
    """The value below which a chi-square variable of ``m`` (even) degrees lies with probability ``p``."""
    low, high = 0.0, 10.0 * m + 100.0
    for _ in range(200):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Cells:
    """The top of the kd-tree: splits as (dimension, value, lower child, upper child), and each cell's box."""

    splits: list[tuple[int, float, int, int]]
    low: np.ndarray
    high: np.ndarray

    def locate(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        if not self.splits:
            return out
        pending = [(0, np.arange(len(points)))]
        while pending:
            at, rows = pending.pop()
            if at < 0:
                out[rows] = -at - 1
                continue
            dim, value, lower, upper = self.splits[at]
            below = points[rows, dim] < value
            pending += [(lower, rows[below]), (upper, rows[~below])]
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        out = np.zeros((len(points), len(self.low)))
        for d in range(points.shape[1]):
            x = points[:, d : d + 1]
            out += np.maximum(0, np.maximum(self.low[:, d] - x, x - self.high[:, d])) ** 2
        return out


def fit_cells(sample: np.ndarray, cells: int) -> Cells:
    """Halve the fullest dimension again and again until there are about ``cells`` boxes."""
    dims = sample.shape[1]
    splits: list[tuple[int, float, int, int]] = []
    boxes: list[tuple[np.ndarray, np.ndarray]] = []

    def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: int) -> int:
        spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(dims)
        dim = int(spread.argmax())
        if wanted <= 1 or spread[dim] == 0:
            boxes.append((low, high))
            return -len(boxes)
        value = float(np.quantile(rows[:, dim], (wanted // 2) / wanted))
        below = rows[:, dim] < value
        if below.all() or not below.any():
            value = float(np.unique(rows[:, dim])[1])
            below = rows[:, dim] < value
        here = len(splits)
        splits.append((dim, value, 0, 0))
        upper, lower = low.copy(), high.copy()
        upper[dim] = lower[dim] = value
        a = grow(rows[below], low, lower, wanted // 2)
        b = grow(rows[~below], upper, high, wanted - wanted // 2)
        splits[here] = (dim, value, a, b)
        return here

    grow(sample, np.full(dims, -np.inf), np.full(dims, np.inf), cells)
    return Cells(splits, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))


@dataclass
class Projection:
    """Lifts and projects vectors of a bounded length."""

    width: int
    radius: float  # the largest norm

    def directions(self) -> np.ndarray:
        return np.random.default_rng(20_240_101).standard_normal((self.width + 1, DIRECTIONS))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.radius**2 - (vectors**2).sum(axis=1)))
        return np.hstack([vectors, rest[:, None]]) @ self.directions()

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors * (self.radius / np.sqrt((vectors**2).sum(axis=1)))[:, None]
        return scaled @ self.directions()[:-1]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten()
    if len(flat) == len(whole) * width and pc.all(pc.equal(pc.list_value_length(whole), width)).as_py():
        return flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    rows = whole.to_pylist()
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Tree:
    """A kd-tree over the projected points of a cell: boxes of its leaves, and the points in leaf order."""

    def __init__(self, projected: np.ndarray) -> None:
        leaves: list[np.ndarray] = []
        pending = [np.arange(len(projected))]
        while pending:
            rows = pending.pop()
            if len(rows) <= LEAF_POINTS:
                leaves.append(rows)
                continue
            dim = int(np.ptp(projected[rows], axis=0).argmax())
            order = rows[np.argpartition(projected[rows, dim], len(rows) // 2)]
            pending += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        self.order = np.concatenate(leaves)  # the cell's points, leaf by leaf
        ends = np.cumsum([len(r) for r in leaves])
        self.spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        self.projected = projected[self.order]
        self.low = np.array([self.projected[a:b].min(axis=0) for a, b in self.spans])
        self.high = np.array([self.projected[a:b].max(axis=0) for a, b in self.spans])
        self.squares = (self.projected**2).sum(axis=1)
        self.verified = 0

    def search(
        self, query: np.ndarray, projected: np.ndarray, vectors: np.ndarray, k: int, norm: float, radius: float, floor: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """The best scores found and their places in leaf order, at least k where there are as many, ties with
        the k-th included; ``vectors`` are in leaf order, ``floor`` is a score that k others are known to reach."""
        gap = np.maximum(0, np.maximum(self.low - projected, projected - self.high))
        bound = (gap**2).sum(axis=1)
        away = self.squares - 2 * (self.projected @ projected) + projected @ projected
        scores, places, kth = np.empty(0), np.empty(0, dtype=np.int64), floor
        for leaf in np.argsort(bound, kind="stable"):
            a, b = self.spans[leaf]
            rows = np.arange(a, b)
            if kth > -math.inf:
                # squared distance of the lifted vectors at this score, the query scaled to the radius
                reach = _STOP * 2 * radius * max(0.0, radius - kth / norm)
                if bound[leaf] > reach:
                    break
                rows = rows[away[a:b] <= reach]
                if not len(rows):
                    continue
            self.verified += len(rows)
            found = vectors[rows] @ query
            better = found >= kth
            scores = np.concatenate([scores, found[better]])
            places = np.concatenate([places, rows[better]])
            if len(scores) > k:
                kth = max(floor, np.partition(scores, len(scores) - k)[len(scores) - k])
                keep = scores >= kth  # ties with the k-th stay
                scores, places = scores[keep], places[keep]
        return scores, places


_STOP = chi_square_quantile(CONFIDENCE)
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search_cell(points: pa.Table, queries: pa.Table, projection: Projection, k: int) -> pa.Table:
    """The k best candidates of each query in one cell (all that tie with the k-th included)."""
    if not points.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    vectors, asked = _matrix(points["vector"], projection.width), _matrix(queries["vector"], projection.width)
    ids = points["ids"].to_pylist()
    projected, wanted = projection.points(vectors), projection.queries(asked)
    tree = Tree(projected)
    vectors, ids = vectors[tree.order], [ids[i] for i in tree.order.tolist()]
    norms = np.sqrt((asked**2).sum(axis=1))
    out: list[list] = [[], [], []]
    floors = queries["floor"].to_pylist()
    for i, query_id in enumerate(queries["query_id"].to_pylist()):
        floor = -math.inf if floors[i] is None else floors[i]
        # one point more than k: the query's own vector may be among them
        scores, places = tree.search(asked[i], wanted[i], vectors, k + 1, norms[i], projection.radius, floor)
        rows = sorted((-score, v) for score, at in zip(scores.tolist(), places.tolist()) for v in ids[at] if v != query_id)
        for score, vec_id in rows[:k]:
            out[0].append(query_id)
            out[1].append(vec_id)
            out[2].append(-score)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best found for each query of ``vec_id, embedding``."""
    clean = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asked"))
    clean = clean.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    spark = vectors.sparkSession
    few = Window.partitionBy("vector").orderBy("vec_id")
    clean = clean.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.first("asked").alias("asked"))  # of the id alone
    first = clean.select("vec_id", "vector").withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)
    points = materialize(first.groupBy("vector").agg(F.collect_list("vec_id").alias("ids")), "points")  # k + 1 ids each
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    stated = points.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.sqrt(F.max(squares))).first()
    count, width, radius = stated
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    projection = Projection(width, radius)
    some = points.orderBy(F.xxhash64("vector")).limit(SAMPLE_POINTS).select("vector").toArrow()
    cells = fit_cells(projection.points(_matrix(some["vector"], width)), max(1, -(-count // CELL_POINTS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells.locate(projection.points(_matrix(batch.column(0), width)))
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["cell", "vector", "ids"])

    placed = materialize(
        points.select("vector", "ids").mapInArrow(place, "cell long, vector array<double>, ids array<long>"), "cells"
    )
    queries = materialize(clean.where("asked").select(F.col("vec_id").alias("query_id"), "vector"), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))

    def visit(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = _matrix(batch.column(1), width)
                wanted = projection.queries(asked)
                if later:
                    norms = np.sqrt((asked**2).sum(axis=1))
                    kth = np.array([-math.inf if x is None else x for x in batch.column(2).to_pylist()])
                    reach = _STOP * 2 * radius * np.maximum(0, radius - kth / norms)
                    hit = cells.distances(wanted) <= reach[:, None]
                    hit[np.arange(len(hit)), cells.locate(wanted)] = False
                    rows, at = np.nonzero(hit)
                else:
                    rows, at = np.arange(len(wanted)), cells.locate(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int64)), *[c.take(pa.array(rows)) for c in batch.columns]],
                    ["cell", "query_id", "vector", "floor"],
                )

        return run

    def ask(some: DataFrame, later: bool) -> DataFrame:
        routed = some.select("query_id", "vector", "floor").mapInArrow(
            visit(later), "cell long, query_id long, vector array<double>, floor double"
        )
        asked = materialize(routed.withColumn("block", block), "visits")
        # a cell is sent once to each block of queries that visits it
        held = placed.join(asked.select("cell", F.col("block").alias("turn")).distinct(), "cell")
        grouped = held.groupBy("cell", "turn").cogroup(asked.groupBy("cell", "block"))
        return grouped.applyInArrow(lambda p, q: _search_cell(p, q, projection, k), "query_id long, vec_id long, score double")

    own = materialize(ask(queries.withColumn("floor", F.lit(None).cast("double")), False), "own-cell")
    best = _top(own, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    others = ask(queries.join(best, "query_id", "left"), True)
    result = _top(own.unionByName(others), k)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
