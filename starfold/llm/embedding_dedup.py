"""Embedding near-dedup on a robust-pruned flat graph.

Vectors of one label are cut into overlapping clusters, a graph is built on each, and
the adjacency lists are united. Every vector then searches the union: greedily from the
medoids to its neighbourhood, and from there through all vectors in range.

A label too large for one graph is cut into regions. Vectors whose links may reach over the
border of two regions are compared in blocks, so that no link depends on where a border lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import materialize, mix64, small
from starfold.llm.components import connected_components
from starfold.llm.vectors import matrix, usable

#: Vectors of a graph that is built by itself on average, and of a region or a part of it that one task searches; clusters of a graph a vector is in.
SHARD_ROWS, REGION_ROWS, OVERLAP = 1000, 6000, 2
#: Rows whose hits are counted at once.
BLOCK_ROWS = 512
#: Most neighbours that building leaves a vector in one shard, and the slack of pruning.
DEGREE, ALPHA, BEAM = 20, 1.2, 24


def centroids(vectors: np.ndarray, count: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Spherical k-means from rows drawn at random."""
    rng = np.random.default_rng(seed)
    centre = vectors[rng.choice(len(vectors), min(count, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(vectors @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centre)
    return centre


def nearest_centroids(vectors: np.ndarray, centre: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centroids of each vector, nearest first."""
    return np.argsort(-(vectors @ centre.T), axis=1, kind="stable")[:, :count]


def reached(unit: np.ndarray, centre: np.ndarray, least: float) -> np.ndarray:
    """Regions (vector, region) that can hold a vector with a cosine of at least ``least``; its own among them.

    A region's vectors are nearer to its centroid than to any other, so they lie beyond the plane
    halfway to each other centroid; a vector farther in front of one of these planes than the
    sine of the angle has no link there.
    """
    near = unit @ centre.T
    if least <= 0:
        return np.ones(near.shape, bool)
    sine = np.sqrt(max(0.0, 1 - least * least))
    apart = np.sqrt(np.maximum(0, 2 - 2 * centre @ centre.T)) if len(centre) else np.zeros((0, 0))
    out = np.ones(near.shape, bool)
    for c in range(len(centre)):
        out &= near[:, c : c + 1] - near <= sine * apart[c] + 1e-9
    return out


class Graph:
    """Adjacency lists over unit vectors; distance is one minus the cosine."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.neighbours: list[np.ndarray] = [np.empty(0, np.int64)] * len(vectors)

    def greedy(self, x: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """All vectors looked at and their distances; the nearest ``beam`` are expanded until none is left."""
        seen = np.zeros(len(self.vectors), bool)
        seen[starts] = True
        ids, distance = starts, 1 - self.vectors[starts] @ x
        expanded = np.zeros(len(ids), bool)
        while True:
            if len(ids) > beam:
                front = np.argpartition(distance, beam - 1)[:beam]
            else:
                front = np.arange(len(ids))
            front = front[~expanded[front]]
            if not len(front):
                return ids, distance
            front = front[np.argsort(distance[front])[:4]]
            expanded[front] = True
            near = np.unique(np.concatenate([self.neighbours[i] for i in ids[front]]))
            near = near[~seen[near]]
            if len(near):
                seen[near] = True
                ids = np.concatenate([ids, near])
                distance = np.concatenate([distance, 1 - self.vectors[near] @ x])
                expanded = np.concatenate([expanded, np.zeros(len(near), bool)])

    def prune(self, node: int, others: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest stays, and drops those that are nearer to it, with slack, than to the node."""
        order = np.argsort(distance, kind="stable")[:64]
        others, distance = others[order], distance[order]
        apart = 1 - self.vectors[others] @ self.vectors[others].T
        open_, kept = np.ones(len(others), bool), []
        for i in range(len(others)):
            if open_[i] and others[i] != node:
                kept.append(others[i])
                if len(kept) == DEGREE:
                    break
                open_ &= ALPHA * apart[i] > distance
        return np.array(kept, np.int64)

    def build(self, rows: np.ndarray, seed: int = 1) -> int:
        """Insert ``rows`` one by one; returns their medoid."""
        rng = np.random.default_rng(seed)
        medoid = int(rows[np.argmax(self.vectors[rows] @ self.vectors[rows].mean(axis=0))])
        local = Graph(self.vectors[rows])
        start = np.array([int(np.flatnonzero(rows == medoid)[0])])
        local.neighbours = [rng.choice(len(rows), min(8, len(rows)), replace=False) for _ in rows]
        for i in rng.permutation(len(rows)):
            ids, distance = local.greedy(local.vectors[i], start, BEAM)
            own = local.neighbours[i]
            ids, at = np.unique(np.concatenate([ids, own]), return_index=True)
            distance = np.concatenate([distance, 1 - local.vectors[own] @ local.vectors[i]])[at]
            local.neighbours[i] = local.prune(i, ids[ids != i], distance[ids != i])
            for j in local.neighbours[i]:
                if i not in local.neighbours[j]:
                    more = np.append(local.neighbours[j], i)
                    if len(more) > DEGREE:
                        more = local.prune(j, more, 1 - local.vectors[more] @ local.vectors[j])
                    local.neighbours[j] = more
        for i, row in enumerate(rows):
            self.neighbours[row] = np.union1d(self.neighbours[row], rows[local.neighbours[i]])
        return medoid

    def both_ways(self) -> None:
        """Add each link's reverse, so that no vector is out of reach: among near copies, which are all about
        equally far apart, pruning leaves some that no list names."""
        sizes = [len(n) for n in self.neighbours]
        source, target = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(self.neighbours)
        pairs = np.unique(np.stack([np.concatenate([source, target]), np.concatenate([target, source])], axis=1), axis=0)
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(sizes) + 1))
        self.neighbours = [pairs[a:b, 1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def in_range(self, node: int, starts: np.ndarray, most: float, beam: int) -> np.ndarray:
        """Vectors found within the distance: the greedy search's, then all that in-range vectors lead to."""
        x = self.vectors[node]
        ids, distance = self.greedy(x, starts, beam)
        seen = np.zeros(len(self.vectors), bool)
        seen[ids] = True
        seen[node] = True
        found = [front := np.unique(np.append(ids[distance <= most], node))]
        while len(front):
            near = np.unique(np.concatenate([self.neighbours[i] for i in front]))
            near = near[~seen[near]]
            seen[near] = True
            front = near[1 - self.vectors[near] @ x <= most]
            found.append(front)
        out = np.concatenate(found)
        return out[out != node]


def exact(left: np.ndarray, right: np.ndarray, least: float, rows: np.ndarray | None = None) -> np.ndarray:
    """Whether each pair (left, right) has a cosine of at least ``least``. With ``rows``, ``left`` are these rows of ``right``."""
    hits = left @ right.T >= least
    if rows is not None:
        hits[np.arange(len(rows)), rows] = False
    return hits


def lacks(unit: np.ndarray, hits: np.ndarray, least: float, audit_rows: int, target: float) -> bool:
    """Whether an audited row has less than ``target`` of its links.

    Audited are ``audit_rows`` rows of each magnitude of links found, so that rows of large
    groups don't speak for others.
    """
    rng = np.random.default_rng(7)
    size = np.ceil(np.log10(hits.sum(axis=1) + 1)).astype(int)
    for magnitude in np.unique(size):
        rows = np.flatnonzero(size == magnitude)
        rows = rng.choice(rows, min(audit_rows, len(rows)), replace=False)
        true = exact(unit[rows], unit, least, rows)
        if ((true & hits[rows]).sum(axis=1) < target * true.sum(axis=1)).any():
            return True
    return False


def search_region(unit: np.ndarray, least: float, beam: int, shard_rows: int, audit_rows: int, target: float) -> np.ndarray:
    """Whether each pair of rows was found to have a cosine of at least ``least``, verified on the vectors.

    A pair that either end found counts at both. If the audit fails, all pairs are compared.
    """
    graph = Graph(unit)
    shards = -(-len(unit) // shard_rows)
    if shards == 1:
        starts = np.array([graph.build(np.arange(len(unit)))])
    else:
        near = nearest_centroids(unit, centroids(unit, shards), OVERLAP)
        starts = np.unique([graph.build(rows) for s in range(shards) if len(rows := np.flatnonzero((near == s).any(axis=1)))])
    graph.both_ways()
    hits = np.zeros((len(unit), len(unit)), bool)
    for q in range(len(unit)):
        found = graph.in_range(q, starts, 1 - least + 1e-9, beam)
        hits[q, found[unit[found] @ unit[q] >= least]] = True
    hits |= hits.T
    if lacks(unit, hits, least, audit_rows, target):
        for at in range(0, len(unit), BLOCK_ROWS):
            rows = np.arange(at, min(at + BLOCK_ROWS, len(unit)))
            hits[rows] = exact(unit[rows], unit, least, rows)
    return hits


class Links:
    """How many rows each row links with, by weight, and a spanning forest, from hits that come in blocks."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.counts, self.root = weight.astype(float), np.zeros(len(weight), np.int64), np.arange(len(weight))

    def add(self, left: np.ndarray, right: np.ndarray, hits: np.ndarray, both: bool = False) -> None:
        """Count the hits (left, right) at the left rows, and on request at the right ones, and join them."""
        for at in range(0, len(left), BLOCK_ROWS):
            rows, block = left[at : at + BLOCK_ROWS], hits[at : at + BLOCK_ROWS]
            self.counts[rows] += (block @ self.weight[right]).astype(np.int64)
            if both:
                self.counts[right] += (self.weight[rows] @ block).astype(np.int64)
            for i in np.flatnonzero(block.any(axis=1)):
                self._join(int(rows[i]), right[block[i]])

    def _join(self, row: int, others: np.ndarray) -> None:
        roots = self.root[others]
        roots = np.unique(np.append(roots[roots != self.root[row]], self.root[row]))
        if len(roots) > 1:
            to = np.arange(len(self.root))
            to[roots] = roots[0]
            self.root = to[self.root]


def deal(distinct: DataFrame, least: float) -> DataFrame:
    """(label, vector, node, weight, low, high, own): the rows of each pair of parts that one task compares.

    Labels over ``REGION_ROWS`` are cut into regions, and regions over it, as near copies
    make them, into parts by hash. A row of part ``own`` comes once for each part of each region it reaches.
    """
    large = {r["label"]: -(-r["n"] // REGION_ROWS) for r in distinct.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > REGION_ROWS).collect()}
    centre: dict = {}
    if large:
        share = min(1.0, 64 * sum(large.values()) / max(distinct.count(), 1))
        part = distinct.filter(F.col("label").isin(list(large))).filter(F.pmod(F.xxhash64("id", "vector"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).select("label", "vector").toPandas()
        for name, group in part.groupby("label"):
            unit = np.array(group["vector"].tolist())
            centre[name] = centroids(unit / np.linalg.norm(unit, axis=1, keepdims=True), large[name])
    kind = distinct.schema["label"].dataType.simpleString()
    nodes = distinct.select("label", "vector", "node", "weight")
    context = distinct.sparkSession.sparkContext
    shared = context.broadcast(centre)

    def by_label(batch: pa.RecordBatch):
        vectors = matrix(batch.column(1))
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        names = np.array(batch.column(0).to_pylist(), object)
        for name in set(names.tolist()):
            at = np.flatnonzero(names == name)
            places = shared.value.get(name)
            yield name, at, unit[at], places, np.zeros(len(at), np.int64) if places is None else nearest_centroids(unit[at], places, 1)[:, 0]

    def regions(stream):
        for batch in small(stream):
            for _, at, _, _, home in by_label(batch) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(home)], names=["label", "region"])

    parts = {name: np.ones(len(centre[name]), np.int64) if name in centre else np.array([n]) for name, n in large.items()}
    if large:
        sizes = nodes.filter(F.col("label").isin(list(large))).mapInArrow(regions, f"label {kind}, region long")
        for r in sizes.groupBy("label", "region").agg(F.count("*").alias("n")).collect():
            if r["label"] in parts:
                parts[r["label"]][r["region"]] = -(-r["n"] // REGION_ROWS)
    dealt = context.broadcast(parts)

    def place(stream):
        for batch in small(stream):
            if not batch.num_rows:
                continue
            node = batch.column(2).to_numpy()
            out, own, met = [], [], []
            for name, at, unit, places, home in by_label(batch):
                count = dealt.value.get(name, np.ones(1, np.int64))
                near = np.ones((len(at), 1), bool) if places is None else reached(unit, places, least)
                row, other = np.nonzero(np.repeat(near, count, axis=1))
                part = (np.cumsum(count) - count)[home] + (mix64(node[at]) % count[home].astype(np.uint64)).astype(np.int64)
                out.append(at[row])
                own.append(part[row])
                met.append(other)
            own, met = np.concatenate(own), np.concatenate(met)
            columns = batch.take(pa.array(np.concatenate(out))).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.minimum(own, met)), pa.array(np.maximum(own, met)), pa.array(own)], names=["label", "vector", "node", "weight", "low", "high", "own"])

    return nodes.mapInArrow(place, f"label {kind}, vector array<double>, node long, weight long, low long, high long, own long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, beam: int = 24, audit_rows: int = 200, target: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Rows of one label link at a cosine of at least ``least``. Rows with null labels or unusable
    vectors (see ``usable``) link with nothing and are their own component. Rows with equal label
    and vector are searched as one. A row with a null key is returned without links. Rows that repeat
    a key are separate, and link with each other if their vectors do. In each
    region, the links of ``audit_rows`` rows of each magnitude of links are counted by brute force;
    if one of them lacks more than the share that ``target`` leaves, all pairs of the region are
    compared, so that the target always holds for the audited. Labels that fill more than one region are
    cut by centroids of a bounded sample, and regions that fill more than one task by hash; a pair of
    parts meets with those of their vectors that can have links across (see ``reached``), which
    are compared exactly.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    good = usable(rows.dropna(subset=["id", "label"]), "vector")
    distinct = good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))  # ids may repeat
    shard_rows = SHARD_ROWS

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, own = table["node"].to_numpy(), table["own"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        vectors = matrix(table["vector"])
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        links = Links(table["weight"].to_numpy())
        if low == high:
            rows = np.arange(len(ids))
            links.add(rows, rows, search_region(unit, least, beam, shard_rows, audit_rows, target))
        else:
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            for at in range(0, len(left), BLOCK_ROWS):
                rows = left[at : at + BLOCK_ROWS]
                links.add(rows, right, exact(unit[rows], unit[right], least), both=True)
        linked = np.flatnonzero(links.counts)
        return pa.table({"node": pa.array(ids[linked]), "n": pa.array(links.counts[linked]), "other": pa.array(ids[links.root[linked]])})

    found = materialize(deal(distinct, least).groupBy("label", "low", "high").applyInArrow(run, "node long, n long, other long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = connected_components(found, "node", "other")
    least_ids = joined.join(distinct.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    groups = distinct.select(F.col("label").alias("l"), F.col("vector").alias("v"), F.col("id").alias("rep"), "weight", "node")
    groups = groups.join(counts, "node", "left").join(joined.join(least_ids, "component"), "node", "left")
    groups = groups.select("l", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.join(groups, (rows["label"] == groups["l"]) & (rows["vector"] == groups["v"]) & rows["id"].isNotNull(), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
