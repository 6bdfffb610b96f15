"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Candidates are dealt to parts; in a part each dimension has a list of the rows in the order of their
component. An anchor reads the lists of all dimensions from the end that its own component's sign
favours, a stretch at a time, and scores the rows that it meets by their whole vectors. No row still unseen can score more
than the threshold: the sum, over dimensions, of the anchor's component times the last one read. Reading stops once the
threshold is strictly below what every search still needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.llm.vectors import matrix
from starfold.session import materialize

#: Rows of a part at most, on average; anchors that travel in one row; rows that a list gives at the first reading.
PART_ROWS, ANCHOR_BLOCK, FIRST_DEPTH = 65_536, 256, 8
#: Components of this size or more are left out with their row: scores could pass 64 bits.
MOST = 1 << 26


class Lists:
    """The sorted lists of a part's rows, and searches over them."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.keys, self.ids, self.labels = keys, ids, labels
        most = int(np.abs(vectors).max(initial=0))
        self.vectors = vectors.astype(np.float64 if most * most * max(1, vectors.shape[1]) < 1 << 52 else np.int64)  # sums of products are exact in either
        self.most = most
        order = np.argsort(vectors, axis=0, kind="stable")
        self.order, self.sorted = order.astype(np.int32), np.take_along_axis(vectors, order, axis=0)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.vectors.dtype == np.float64 and self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 52:
            return (self.vectors[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows].astype(np.int64) @ anchor

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Stretches of rows not met before: (rows, scores, what an unseen row can score at most)."""
        n = len(self.keys)
        used = np.flatnonzero(anchor)
        falls = anchor[used] > 0  # these lists are read from their end
        new = np.ones(n, bool)
        at, depth = 0, FIRST_DEPTH if len(used) else n
        while at < n and new.any():
            to = min(n, at + depth)
            meets = np.zeros(n, bool)
            if len(used):
                meets[self.order[at:to, used[~falls]]] = True
                meets[self.order[n - to : n - at, used[falls]]] = True
            else:
                meets[:] = True
            rows = np.flatnonzero(meets & new)
            new[rows] = False
            last = np.where(falls, self.sorted[n - to, used], self.sorted[to - 1, used])
            yield rows, self.scores(rows, anchor), int(last @ anchor[used])
            at, depth = to, depth * 2

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The places of the ``k`` first rows: higher scores, then smaller ids, then smaller keys."""
        if len(rows) > 4 * k:  # only those that reach the k-th score need sorting
            rows_at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            rows_at = np.arange(len(rows))
        return rows_at[np.lexsort([self.keys[rows[rows_at]], self.ids[rows[rows_at]], -scores[rows_at]])[:k]]

    def positives(self, key: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the first ``k`` other rows of the anchor's label."""
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for more, values, threshold in self.read(anchor):
            fits = (self.labels[more] == label) & (self.keys[more] != key)
            rows, scores = np.concatenate([rows, more[fits]]), np.concatenate([scores, values[fits]])
            top = self.best(rows, scores, k)
            rows, scores = rows[top], scores[top]
            if len(rows) == k and threshold < scores[-1]:
                break
        return rows, scores

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (low, high): (rows, scores) of the first ``k`` rows of other labels with low <= score <= high."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        waiting = [i for i, (low, high) in enumerate(windows) if low <= high]
        reading = self.read(anchor) if waiting else ()
        for more, values, threshold in reading:
            other = self.labels[more] != label
            more, values = more[other], values[other]
            for i in list(waiting):
                low, high = windows[i]
                fits = (values >= low) & (values <= high)
                rows, scores = np.concatenate([found[i][0], more[fits]]), np.concatenate([found[i][1], values[fits]])
                top = self.best(rows, scores, k)
                found[i] = rows[top], scores[top]
                if threshold < low or len(top) == k and threshold < scores[top[-1]]:
                    waiting.remove(i)
            if not waiting:
                break
        return found


def _taking_part(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector of longs, key): rows that take part, equal ones once."""
    x, named = F.col("vector"), lambda c: F.col(f"`{c}`")
    rows = df.select(named(key).cast("long").alias("id"), named(label).cast("long").alias("label"), named(vector).cast("array<double>").alias("vector"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(MOST >> 8)))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    lengths = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size(x) == (lengths[0]["n"] if lengths else 0))
    rows = rows.select("id", "label", F.transform(x, lambda v: F.floor(v * 256).cast("long")).alias("vector"))
    return rows.withColumn("key", F.xxhash64("id", "label", "vector")).distinct()


def _windows(scores: list[int], low: int, whole: int) -> list[tuple[int, int]]:
    """Scores s with low * p <= whole * s <= whole * p, for each positive's score p."""
    return [(-(-low * p // whole), p) for p in scores]


def mine(candidates: DataFrame, anchors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors become integers, floor(256 * x) of each component; scores are inner products with the anchor, and rows come by
    score descending, then id ascending. An anchor's positives are its first ``positives`` other candidates of its
    label; for each, the first ``negatives`` candidates of other labels that score at least ``low`` percent of the
    positive's score and no more than it, ranked from 1. A negative positive score leaves no window, hence no row.

    Rows take no part with a null key, label or vector, a null or non-finite component, one of 2 ** 18 or more in size
    (scores could pass 64 bits), or another length than most. Rows equal in key, label and vector count once; those
    that repeat only a key are rows of their own, and as anchors each has its rows under that key. Columns other than the three named aren't read. Empty tables give no rows.

    Every candidate lies in one part; anchors, which are a stated set, visit all parts in blocks. A part's task holds its own rows and
    one block; what it returns is bounded by the anchors' positives.
    """
    spark = candidates.sparkSession
    rows = materialize(_taking_part(candidates, key, vector, label))
    asked = _taking_part(anchors, key, vector, label).join(rows.select(F.size("vector").alias("n")).limit(1), F.size("vector") == F.col("n"), "left_semi")
    total = rows.count()
    parts = max(1, -(-total // PART_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1024)))
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("block"), F.array(F.struct("key", "id", "label", "vector", F.lit(None).cast("array<long>").alias("scores"))).alias("rows"))

    def meet(asking: DataFrame, answer, schema: str) -> DataFrame:
        """``asking`` (key, id, label, vector, scores) in blocks, each sent to every part after the part's own rows."""
        block = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-asking.count() // ANCHOR_BLOCK)))).cast("int") + 1
        packed = asking.groupBy(block.alias("block")).agg(F.collect_list(F.struct("key", "id", "label", "vector", "scores")).alias("rows"))
        sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block", "rows")
        met = dealt.union(sent).repartition(parts, "part").sortWithinPartitions("part", "block")

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, lists = None, [], None
            for batch in stream:
                of, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                ends = np.flatnonzero((of[1:] != of[:-1]) | (block[1:] != block[:-1])) + 1
                for lo, hi in zip([0, *ends], [*ends, len(of)], strict=True):
                    own = batch.column(2).slice(lo, hi - lo).flatten()
                    if of[lo] != part:
                        part, held, lists = of[lo], [], None
                    if block[lo] == 0:
                        held.append(own)
                    elif held:
                        if lists is None:
                            every = pa.concat_arrays(held)
                            lists = Lists(*(every.field(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "label")), matrix(every.field("vector")).astype(np.int64))
                        yield from answer(lists, own)

        return met.mapInArrow(run, schema)

    def find_positives(lists: Lists, asking: pa.StructArray) -> Iterator[pa.RecordBatch]:
        out = [[], [], [], []]
        for own, of, anchor in zip(asking.field("key").to_pylist(), asking.field("label").to_pylist(), matrix(asking.field("vector")).astype(np.int64), strict=True):
            found, scores = lists.positives(own, of, anchor, positives)
            for column, values in zip(out, (np.full(len(found), own), lists.keys[found], lists.ids[found], scores), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["key", "positive", "id", "score"])

    def find_negatives(lists: Lists, asking: pa.StructArray) -> Iterator[pa.RecordBatch]:
        out = [[], [], [], []]
        for own, of, anchor, scores in zip(asking.field("key").to_pylist(), asking.field("label").to_pylist(), matrix(asking.field("vector")).astype(np.int64), asking.field("scores").to_pylist(), strict=True):
            for score, (found, values) in zip(scores, lists.negatives(of, anchor, _windows(scores, low, 100), negatives), strict=True):
                for column, more in zip(out, (np.full(len(found), own), np.full(len(found), score), lists.ids[found], values), strict=True):
                    column.append(more)
        columns = [pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in out]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "positive_score", "negative_id", "negative_score"])

    asking = materialize(asked.withColumn("scores", F.lit(None).cast("array<long>")))
    found = meet(asking, find_positives, "key long, positive long, id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id", "positive")
    chosen = materialize(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))

    scored = chosen.groupBy("key").agg(F.collect_set("score").alias("scores"))  # equal scores have one window
    found = meet(materialize(asking.drop("scores").join(scored, "key")), find_negatives, "key long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("key", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = chosen.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(asking.select("key", F.col("id").alias("anchor_id")), "key")
    return named.join(first, ["key", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
