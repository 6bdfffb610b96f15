"""Event-time streams with bounded state (an extension): closed segments, completions that count once, and their progress.

A watermark trails the latest time seen by ``delay``: rows that come later than that are dropped and counted,
and what the watermark has passed is emitted once and leaves the state.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from starfold.streaming.sessions import shared_folder

#: Fixed value: the store that keyed processors with timers need.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closed_sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Segments by key that the watermark has passed: (key, n, first, last), each once. A gap longer than ``gap`` ends one."""
    s = stream.withWatermark(time, delay)
    return s.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).drop("w")


def first_completions(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key to arrive; others that come within ``delay`` of it count nothing. A key leaves the state once the watermark is past it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class ProgressLog(StreamingQueryListener):
    """What each batch took in, dropped as late and left in the state; the last ``most`` batches of all queries.

    ``emit`` gets each of them as it ends, as a dictionary: to print it as a line of JSON, say.
    """

    def __init__(self, most: int = 1000, emit: Callable[[dict], None] | None = None):
        self.batches: deque[dict] = deque(maxlen=most)
        self.emit = emit
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended.pop(str(event.id), None)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        found = {"query": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "watermark": (p.eventTime or {}).get("watermark")}
        found |= {"late": sum(o.numRowsDroppedByWatermark for o in p.stateOperators), "state_rows": sum(o.numRowsTotal for o in p.stateOperators)}
        self.batches.append(found)
        if self.emit:
            self.emit(found)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception


def append_to_end(spark: SparkSession, result: DataFrame, out: str | None = None, progress: str | None = None, work: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process all that has arrived, in append mode, and return all rows that were ever emitted.

    Each batch overwrites the folder of its own number, so that one tried again after a failure leaves its rows once.
    With the same ``out`` and ``progress`` folders a later call goes on where the one before ended.
    """
    out, progress = out or shared_folder(spark, "stream-out"), progress or shared_folder(spark, "stream-progress")

    def write(batch: DataFrame, number: int) -> None:
        (work(batch) if work else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        q = result.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    q.awaitTermination()
    try:
        return spark.read.parquet(out).drop("batch")
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):  # no batch has run
            return spark.createDataFrame([], result.schema)
        raise


def arrivals(spark: SparkSession, rows: DataFrame, time_us: str, files: int, scatter_us: int, name: str = "arrivals") -> DataFrame:
    """``rows`` as a stream of ``files`` files, a batch each, in the order of time but for ``scatter_us`` at most, by a hash of the row.

    For queries and tests: a table stands for what would arrive.
    """
    folder = shared_folder(spark, name)
    first, last = rows.agg(F.min(time_us), F.max(time_us)).first()
    span = max(1, -(-((last or 0) - (first or 0) + scatter_us + 1) // files))
    shifted = F.col(time_us) - F.lit(first or 0) + F.pmod(F.xxhash64(*rows.columns), F.lit(scatter_us + 1))
    dealt = rows.withColumn("_file", F.floor(shifted / span).cast("int"))
    for k in range(files):
        dealt.filter(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files come in the order of their times
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
