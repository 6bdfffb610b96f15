"""Streaming forms (an extension): gap segments as session windows, and running statistics of targets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold import session


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared one."""
    return f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def sessions(stream: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Segments by key: a gap longer than ``gap`` ends one, a gap just as long doesn't."""
    return stream.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).drop("w")


def target_statistics(stream: DataFrame, key: str, value: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def run_to_end(spark: SparkSession, result: DataFrame, work: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process all that has arrived, and return the final state.

    Each batch overwrites the folder of its own number, so a batch that is tried again leaves the same rows.
    """
    out, progress = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-progress")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        (work(batch) if work else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    q = result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/batch={last[-1]}") if last else spark.createDataFrame([], result.schema)
