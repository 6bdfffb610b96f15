"""Approximate nearest neighbours by stable projections, a kd-tree over them, and a chi-square stopping test.

A few Gaussian projections of two vectors differ by their distance times a chi variate. So
if the nearest projection not yet seen is farther, in squares, than the chi-square quantile
of ``confidence`` times the squared k-th best true distance, then any nearer vector has been
seen with that confidence, and the search stops.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.vectors import chi_square_quantile, matrix, usable
from starfold.session import materialize


def projections(dimension: int, width: int, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimension, width))


def split(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: median splits of the widest coordinate down to ``size`` rows."""
    leaves, todo = [], [rows]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            leaves.append(part)
            continue
        axis = int(np.argmax(np.ptp(points[part], axis=0)))
        order = part[np.argsort(points[part, axis], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return leaves


@dataclass(frozen=True)
class Cells:
    """The top of the kd-tree, fitted on a bounded sample: every point of the space lies in one cell."""

    axis: list[int]
    cut: list[float]
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, width: int, cells: int) -> Cells:
        depth = max(0, (cells - 1).bit_length())
        axis, cut, boxes = [], [], [(sample, np.full(width, -np.inf), np.full(width, np.inf))]
        for _ in range(depth):
            below = []
            for points, low, high in boxes:
                a = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
                c = float(np.median(points[:, a])) if len(points) else 0.0
                axis.append(a)
                cut.append(c)
                left, right = high.copy(), low.copy()
                left[a] = right[a] = c
                below += [(points[points[:, a] < c], low, left), (points[points[:, a] >= c], right, high)]
            boxes = below
        return cls(axis, cut, np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes]))

    def of(self, points: np.ndarray) -> np.ndarray:
        at, first = np.zeros(len(points), np.int64), 0
        axis, cut = np.array(self.axis, np.int64), np.array(self.cut)
        while first < len(self.axis):
            node = first + at
            at = 2 * at + (points[np.arange(len(points)), axis[node]] >= cut[node])
            first = 2 * first + 1
        return at

    def reached(self, point: np.ndarray, square: float) -> np.ndarray:
        """Cells no farther than the squared distance."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= square)


class Tree:
    """One part of a cell: its vectors, their projections, and the boxes of the leaves of its kd-tree. ``names`` tell rows apart, ids may repeat."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, vectors: np.ndarray, points: np.ndarray, leaf: int = 64):
        order = np.lexsort((names, ids))
        self.ids, self.names, self.vectors, self.points = ids[order], names[order], vectors[order], points[order]
        self.leaves = split(self.points, np.arange(len(ids)), leaf)
        self.low = np.array([self.points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.array([self.points[rows].max(axis=0) for rows in self.leaves])

    def nearest(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, factor: float, bound: float, leaves: int = 32, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest found, without the row named ``own``; equal distances go by id. Neighbours come by projected distance and are verified until the next one fails the test.

        ``leaves`` leaves are opened once every projected neighbour nearer than their boxes is verified; neighbours are
        verified ``step`` at a time, then twice as many. ``bound`` is a k-th distance known already.
        """
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        square = (gap * gap).sum(axis=1)
        best_at, best = np.empty(0, np.int64), np.empty(0)
        kth = bound
        turn = np.argsort(square, kind="stable")
        turn = turn[square[turn] <= factor * kth * kth]
        far, waiting = np.empty(0), np.empty(0, np.int64)  # projected squares of opened rows that aren't verified
        for at in range(0, len(turn) + leaves, leaves):
            edge = min(square[turn[at]] if at < len(turn) else np.inf, factor * kth * kth)
            now = far <= edge
            order = np.argsort(far[now], kind="stable")
            ready, rows_ready = far[now][order], waiting[now][order]
            while len(ready):
                if ready[0] > factor * kth * kth:
                    return best_at, best
                rows, ready, rows_ready, step = rows_ready[:step], ready[step:], rows_ready[step:], min(2 * step, 512)
                difference = self.vectors[rows] - vector
                distance = np.sqrt((difference * difference).sum(axis=1))
                good = (self.names[rows] != own) & (distance <= kth)
                if good.any():
                    best_at, best = np.concatenate([best_at, rows[good]]), np.concatenate([best, distance[good]])
                    order = np.lexsort((best_at, best))[:k]  # rows lie in the order of their ids
                    best_at, best = best_at[order], best[order]
                    if len(best) == k:
                        kth = min(kth, float(best[-1]))
            if at >= len(turn) or square[turn[at]] > factor * kth * kth:
                return best_at, best
            rows = np.concatenate([self.leaves[leaf] for leaf in turn[at : at + leaves]])
            off = self.points[rows] - point
            more = np.einsum("ij,ij->i", off, off)
            far, waiting = np.concatenate([far[~now], more]), np.concatenate([waiting[~now], rows])
            near = far <= factor * kth * kth
            far, waiting = far[near], waiting[near]
        return best_at, best


#: Rows of a cell on average and of a part of it, cells at most, sampled rows to place the cells by, queries that meet a part in one task.
CELL_ROWS, PART_ROWS, MOST_CELLS, SAMPLE_ROWS, QUERY_BLOCK = 8000, 16_000, 4096, 20_000, 4000


def _by_cell(rows: DataFrame, cells: int, size: int) -> np.ndarray:
    """How many parts of ``size`` rows each cell needs; one number a cell comes to the driver, and there are at most MOST_CELLS cells."""
    parts = np.ones(cells, np.int64)
    for cell, n in rows.groupBy("cell").agg(F.count("*")).collect():
        parts[cell] = -(-n // size)
    return parts


def search(candidates: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, width: int = 10, confidence: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest candidates found by Euclidean distance, itself left out.

    Ranks start at 1; equal distances go by the smaller key; fewer than ``k`` candidates are all
    returned. Unusable vectors (see ``usable``) and null keys take no part on either side; rows
    that repeat a key and vector count once. Rows of one key with different vectors are rows of their own: each can be
    found, by the others too, and as queries each has its own ranks under that key. Other columns aren't read. The cells are placed by a bounded
    sample, but every candidate is indexed. A query first searches its own cell; its k-th distance
    there says which other cells the stopping test still asks for. A cell of many rows, such as one of equal vectors, is
    dealt by hashed key to parts, each of which answers all of the cell's queries; only where a cell has more queries than
    fit into a task are its rows copied, once for each block of them.
    """
    columns = [F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")]
    row = F.xxhash64("id", "vector").alias("row")
    rows = usable(candidates.select(*columns).dropna(subset=["id"]), "vector").select("id", row, "vector")
    sample = rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE_ROWS).select("vector").toPandas()
    shape = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if sample.empty:
        return rows.sparkSession.createDataFrame([], shape)
    points = np.array(sample["vector"].tolist(), float)
    plane = projections(points.shape[1], width)
    total = rows.count()
    cells = Cells.fit(points @ plane, width, min(MOST_CELLS, -(-total // CELL_ROWS)))
    factor = chi_square_quantile(confidence, width)
    asked = queries.select(*columns).dropna(subset=["id"]).filter(F.size("vector") == points.shape[1])
    asked = usable(asked, "vector").select("id", row, "vector")
    shared = rows.sparkSession.sparkContext.broadcast((cells, plane))

    def place(stream):
        cells, plane = shared.value
        for batch in stream:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(cells.of(matrix(batch.column(2)) @ plane)), *batch.columns], names=["cell", "id", "row", "vector"])

    def visit(table: pa.Table, asking: pa.Table) -> pa.Table:
        plane = shared.value[1]
        found = {"query": [], "query_id": [], "vec_id": [], "row": [], "score": []}
        if table.num_rows and asking.num_rows:
            names, at = np.unique(table["row"].to_numpy(), return_index=True)  # rows equal in id and vector
            vectors = matrix(table["vector"])[at]
            tree = Tree(table["id"].to_numpy()[at], names, vectors, vectors @ plane)
            wanted = matrix(asking["vector"])
            for own, of, x, bound in zip(asking["row"].to_pylist(), asking["id"].to_pylist(), wanted, asking["bound"].to_pylist(), strict=True):
                near, distance = tree.nearest(own, x, x @ plane, k, factor, bound)
                for column, values in zip(found.values(), (np.full(len(near), own), np.full(len(near), of), tree.ids[near], tree.names[near], distance), strict=True):
                    column.append(values)
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.float64() if n == "score" else pa.int64()) for n, v in found.items()})

    hits = "query long, query_id long, vec_id long, row long, score double"
    schema = "cell long, id long, row long, vector array<double>"
    placed = rows.mapInArrow(place, schema)
    home = asked.mapInArrow(place, schema).distinct().withColumn("bound", F.lit(1e300))
    parts = _by_cell(placed, len(cells.low), PART_ROWS)
    h = F.xxhash64("row")

    def meet(asking: DataFrame) -> DataFrame:
        of = lambda sizes: F.get(F.array(*[F.lit(int(n)) for n in sizes]), F.col("cell").cast("int"))
        blocks = _by_cell(asking, len(parts), QUERY_BLOCK)
        every = lambda sizes: F.explode(F.sequence(F.lit(0), of(sizes) - 1)) if sizes.max() > 1 else F.lit(0)
        one = lambda sizes: F.pmod(h, of(sizes)).cast("int") if sizes.max() > 1 else F.lit(0)
        left = placed.withColumn("part", one(parts)).withColumn("block", every(blocks))
        right = asking.withColumn("block", one(blocks)).withColumn("part", every(parts))
        keys = ["cell", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: visit(a, b), hits)

    def ranked(found: DataFrame) -> DataFrame:
        """The k nearest of each query; one short array a query."""
        return found.groupBy("query", "query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id", "row"))), 1, k).alias("best"))

    first = materialize(ranked(meet(home)))
    known = first.select(F.col("query").alias("row"), F.when(F.size("best") >= k, F.element_at("best", k)["score"]).otherwise(1e300).alias("bound"))

    def route(stream):
        cells, plane = shared.value
        for batch in stream:
            vectors, bounds, homes = matrix(batch.column(3)), batch.column(4).to_pylist(), batch.column(0).to_pylist()
            for i, x in enumerate(vectors):
                # a bound of no use (too few rows at home) leads to all cells
                more = cells.reached(x @ plane, factor * bounds[i] * bounds[i] if bounds[i] < 1e300 else np.inf)
                more = more[more != homes[i]]
                part = batch.take(pa.array(np.full(len(more), i)))
                yield pa.RecordBatch.from_arrays([pa.array(more.astype(np.int64)), *part.columns[1:]], names=["cell", "id", "row", "vector", "bound"])

    again = home.drop("bound").join(known, "row", "left").select("cell", "id", "row", "vector", F.coalesce("bound", F.lit(1e300)).alias("bound"))
    routed = again.mapInArrow(route, "cell long, id long, row long, vector array<double>, bound double")
    seen = first.select("query", "query_id", F.explode("best").alias("x")).select("query", "query_id", "x.vec_id", "x.row", "x.score")
    best = ranked(seen.union(meet(routed)))
    return best.select("query_id", F.posexplode("best").alias("rank", "found")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("found.vec_id").alias("vec_id"), F.col("found.score").alias("score"))
