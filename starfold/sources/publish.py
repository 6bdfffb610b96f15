"""Frozen tables: written aside, digested, and published by one rename; what is published is never replaced."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file that says what a frozen table holds.
STATEMENT = "_frozen.json"


class FrozenDiffers(ValueError):
    """A frozen table exists and isn't what was to be published."""


def digest(rows: DataFrame, leave_out: Sequence[str] = ()) -> dict[str, object]:
    """What a table holds, whatever the order of its rows: its columns and types, the number of rows, and a sum of their hashes.

    A row's hash is SHA-256 of its JSON; the sum is modulo 2 ** 120 and is taken as four parts of 30 bits, so that it never overflows.
    """
    kept = sorted(c for c in rows.columns if c not in leave_out)
    named = rows.select(*[F.col(f"`{c}`") for c in kept])
    text = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(text, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) % (1 << 30) for k in range(4)]
    found = named.agg(F.count("*").alias("n"), *[F.coalesce(p, F.lit(0)).cast("long").alias(f"p{k}") for k, p in enumerate(parts)]).first()
    return {"columns": [f"{f.name}: {f.dataType.simpleString()}" for f in named.schema.fields], "rows": found["n"], "sum": "".join(f"{found[f'p{k}']:08x}" for k in range(4))}


def _files(spark: SparkSession, path: str):
    """(file context, path) of Hadoop, for any store that Spark writes to."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    at = at.getFileSystem(conf).makeQualified(at)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf), at


def exists(spark: SparkSession, path: str) -> bool:
    context, at = _files(spark, path)
    return context.util().exists(at)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """One step that fails if the target is there."""
    context, a = _files(spark, source)
    _, b = _files(spark, target)
    plain = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(a, b, plain)


def freeze(rows: DataFrame, target: str, leave_out: Sequence[str] = ()) -> dict[str, object]:
    """Publish ``rows`` as the frozen table ``target`` and return its statement.

    Where a frozen table of equal content is there already, it stays and its own statement is returned; of other content, ``FrozenDiffers``.
    Columns in ``leave_out`` (when something was found, say) aren't compared. Until the rename nothing is to be seen under
    ``target``, whatever fails; of two that publish at once one succeeds, and the other compares.
    """
    spark = rows.sparkSession
    if not exists(spark, target):
        aside = f"{target.rstrip('/')}.{uuid.uuid4().hex}.part"
        rows.write.parquet(aside)
        written = digest(spark.read.parquet(aside), leave_out) | {"left_out": sorted(leave_out)}
        write_text(spark, f"{aside}/{STATEMENT}", json.dumps(written, indent=2, sort_keys=True) + "\n")
        try:
            rename(spark, aside, target)
            return written
        except Exception as fault:
            if not exists(spark, target):
                raise
            _files(spark, aside)[0].delete(_files(spark, aside)[1], True)  # another one was first
            if "exist" not in str(fault).lower():
                raise
    there = statement(spark, target)
    proposed = digest(rows, there["left_out"])
    if any(proposed[k] != there[k] for k in ("columns", "rows", "sum")):
        raise FrozenDiffers(f"{target} is frozen with {there['rows']} rows, and differs from what was to be published")
    return there


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, in any store."""
    _, at = _files(spark, path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def statement(spark: SparkSession, target: str) -> dict[str, object]:
    """What was published; an error if nothing was, or if it was never finished."""
    _, at = _files(spark, f"{target}/{STATEMENT}")
    source = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def read_frozen(spark: SparkSession, target: str, verify: bool = True) -> DataFrame:
    """The frozen table; ``verify`` counts and sums it again first, and raises ``FrozenDiffers`` if it isn't what its statement says."""
    there, rows = statement(spark, target), spark.read.parquet(target)
    if verify:
        now = digest(rows, there["left_out"])
        if any(now[k] != there[k] for k in ("columns", "rows", "sum")):
            raise FrozenDiffers(f"{target} isn't what it was when it was frozen")
    return rows
