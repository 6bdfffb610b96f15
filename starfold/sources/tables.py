"""Tables, and the light curves that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular curves over a month: one target a user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("target_id"),
        F.col("event_type").alias("product_id"),
        F.col("event_id").alias("cadence"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 86400e6).alias("time_days"),
        F.col("value").alias("flux"),
        F.get_json_object("props", "$.k").cast("bigint").alias("quality"),
    )


def lineitem_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long curves with ties in time: one target a supplier."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("target_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cadence"),
        F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("time_days"),
        F.col("l_extendedprice").alias("flux"),
        F.col("l_quantity").cast("double").alias("flux_error"),
        F.col("l_linenumber").cast("bigint").alias("quality"),
        F.col("l_discount").alias("centroid_column"),
        F.col("l_tax").alias("centroid_row"),
    )


#: The same curves for the oracle.
EVENTS_SQL = """curve AS (SELECT user_id AS target_id, event_type AS product_id, event_id AS cadence,
 (epoch_us(ts) - 1704067200000000) / 86400e6 AS time_days, value AS flux, CAST(json_extract(props, '$.k') AS BIGINT) AS quality FROM events)"""
LINEITEM_SQL = """curve AS (SELECT l_suppkey AS target_id, l_orderkey * 10 + l_linenumber AS cadence,
 CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS time_days, l_extendedprice AS flux,
 CAST(l_quantity AS DOUBLE) AS flux_error, CAST(l_linenumber AS BIGINT) AS quality, l_discount AS centroid_column, l_tax AS centroid_row FROM lineitem)"""
