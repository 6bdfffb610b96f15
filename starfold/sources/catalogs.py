"""Manifests, label and split snapshots, catalogs and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_entries(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Rows of the array ``field`` of a JSON document: a manifest's entries, labels, assignments."""
    return spark.read.json(path, multiLine=True).select(F.inline(field))


def require(rows: DataFrame, columns: list[str], unique: str | None = None) -> DataFrame:
    """The rows, once their columns are there and ``unique`` repeats in none of them."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"columns missing: {missing}")
    if unique and (twice := rows.groupBy(unique).count().filter("count > 1").limit(5).collect()):
        raise ValueError(f"{unique} repeats: {[r[0] for r in twice]}")
    return rows


def read_csv_catalog(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    first = rows.columns[0]
    return require(rows.withColumnRenamed(first, first.lstrip("﻿")), columns)


def read_tab_catalog(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Tab-separated text with comments and rulers: the line that starts with ``key`` names the columns, lines that start with digits are rows."""
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith(key + "\t")).first()
    if header is None:
        raise ValueError(f"no header line that starts with {key}")
    names = header[0].split("\t")
    parts = F.split("value", "\t")
    return lines.filter(F.col("value").rlike(r"^\s*\d+\t")).select(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs)


def read_inventory(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Lines of text that a pattern matches, its groups as columns."""
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


#: Tables of a bundle, each partitioned by its analysis.
BUNDLE = ("results", "cadences", "periodograms", "candidates")


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """New tables only: a bundle that exists is an error, never overwritten."""
    for name in BUNDLE:
        if name in tables:
            tables[name].write.mode("errorifexists").partitionBy("analysis_id").parquet(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, names: tuple[str, ...] = BUNDLE) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def integrity(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of all files of a bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.substring_index("path", folder.rstrip("/") + "/", -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def intact(spark: SparkSession, folder: str, recorded: DataFrame) -> bool:
    """Whether each recorded file is there with its hash; files that nobody recorded count too."""
    now = integrity(spark, folder)
    return not now.exceptAll(recorded.select("path", "sha256")).union(recorded.select("path", "sha256").exceptAll(now)).limit(1).count()
