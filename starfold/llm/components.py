"""Connected components of links between ids, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import materialize


def smallest_reachable(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the links, within memory."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as links to the smallest node of each of its own components."""
    for batch in stream:
        node, root = smallest_reachable(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        apart = node != root
        yield pa.RecordBatch.from_arrays([pa.array(root[apart]), pa.array(node[apart])], names=["low", "high"])


def _link(low: str, high: Column) -> Column:
    return F.struct(F.col(low).alias("low"), high.alias("high"))


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): for every node of a link, the smallest node that links lead to; longs.

    Links may repeat, point either way or lead to themselves; those with a null count nothing.
    Each task first shrinks its links to stars. Then rounds of pointing large neighbours and
    small ones at the smallest alternate, until every node points at its component. Nothing is
    collected, and a round's rows are at most the links. No links give no rows.
    """
    edges = links.select(F.col(left).cast("long").alias("low"), F.col(right).cast("long").alias("high")).dropna().filter("low <> high")
    edges = materialize(edges.mapInArrow(_forest, "low long, high long").distinct())
    while True:  # a link's low end is always less than its high one
        ends = edges.select(F.inline(F.array(_link("low", F.lit(0)), _link("high", F.lit(1))))).groupBy("low").agg(F.sum("high").alias("above"), F.count("*").alias("links"))
        if not ends.filter("above > 0 and links > 1").count():
            break
        both = edges.select(F.inline(F.array(_link("low", F.col("high")), _link("high", F.col("low")))))
        least = both.groupBy("low").agg(F.least(F.min("high"), F.first("low")).alias("root"))
        large = edges.join(least, "low").select(F.col("root").alias("low"), "high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("root"))
        small = large.join(least, "high")
        edges = materialize(small.select(F.inline(F.array(_link("root", F.col("high")), _link("root", F.col("low"))))).filter("low <> high").distinct())
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
