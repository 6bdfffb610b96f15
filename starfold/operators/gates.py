"""Checks that ride along: a row that breaks one fails the job that reads it, with no pass of its own.

Each gate returns its input's rows unchanged. A gate on single rows stays in their stage; one on neighbours or repeats is a window by the key
that the work behind it mostly shuffles by anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def _held(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows for which the condition isn't true stop the job; a condition that is null counts as broken."""
    return rows.filter(F.assert_true(F.coalesce(condition, F.lit(False)), message).isNull())


def require_rows(rows: DataFrame, **conditions: Column) -> DataFrame:
    """Conditions by name; the name is the error's text."""
    for name, condition in conditions.items():
        rows = _held(rows, condition, name)
    return rows


def strictly_increasing(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``value`` rises from row to row of each key, in the order of ``order``."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return _held(rows.withColumn("_before", before), F.col("_before").isNull() | (F.col(value) > F.col("_before")), f"{value} doesn't rise strictly within {', '.join(keys)}").drop("_before")


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """No two rows agree in all keys (nulls agree). A key's second row is enough to stop, so none is gathered beyond its task's sort."""
    w = Window.partitionBy(*keys).orderBy(F.lit(0))
    return _held(rows.withColumn("_nth", F.row_number().over(w)), F.col("_nth") == 1, f"{', '.join(keys)} repeats").drop("_nth")


def only_in(rows: DataFrame, column: str, *values: str) -> DataFrame:
    """Every row's ``column`` is one of the values: what trains a model comes from the training partition."""
    return _held(rows, F.col(column).isin(*values), f"{column} must be one of {', '.join(values)}")


def same_groups(labels: DataFrame, assignments: DataFrame, group: str, label: str) -> DataFrame:
    """Labels with their assignment: every group is on both sides, with the same label."""
    x = labels.join(assignments.withColumnRenamed(label, "_assigned").withColumn("_there", F.lit(True)), group, "full")
    x = _held(x, F.col("_there").isNotNull(), f"a labeled {group} has no assignment")
    x = _held(x, F.col(label).isNotNull(), f"an assigned {group} has no label")
    return _held(x, F.col("_assigned").eqNullSafe(F.col(label)), f"label and assignment of a {group} differ").drop("_assigned", "_there")


def counted(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has the number of all and of those that meet each condition once a job has read them."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]), seen
