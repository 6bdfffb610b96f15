"""Sharding by proportional stratified interleaving.

Within each stratum (source) rows are shuffled by a seeded hash and ranked. A row's
fractional rank, its place in its stratum from 0 to 1, is its place in the whole: all rows in
the order of fractional ranks are cut into runs of equal length, so that every shard has its
share of every stratum. Both ranks are counted by cells: a row's cell is the head of its
sort key, so a task numbers one cell's rows and adds the rows of the cells before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.llm.common import others
from starfold.session import materialize

#: Rows of a cell on average; binary digits of a cell's number at most: with more rows than CELL_ROWS << MOST_BITS cells grow, and Spark sorts them by spilling.
CELL_ROWS, MOST_BITS = 512, 16
#: A cell of one stratum with more rows than this, and than the total >> HOT_BITS, has rows of one key; it is dealt to several parts.
HOT_ROWS, HOT_BITS = 65_536, 14


def _cell_bits(rows: int) -> int:
    return min(MOST_BITS, (rows // CELL_ROWS).bit_length())


def shuffle_key(seed: int, columns: Sequence) -> F.Column:
    """60 bits of the MD5 of the seed and the columns as text, nulls left out."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int, stratum: str = "source", key: Sequence[str] = ("doc_id",), seed: int = 13) -> DataFrame:
    """``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    Numbers of rows of any two shards differ by at most one, and so do, up to two rows, those of
    a stratum in any two shards. A null stratum is a stratum of its own. ``key`` columns (of orderable types, nulls
    allowed) decide the shuffle; rows that agree in all of them are in any order among themselves, and are each
    placed. Columns named shard or slot, in any letter case, are replaced; all others are kept. An
    empty table gives no rows; with fewer rows than shards some shards stay empty.

    Rows are written twice to the shared folder and shuffled twice: hand over narrow rows. No step sorts a stratum,
    a shard or a key's rows in one task.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    named = lambda c: F.col(f"`{c}`")
    base = docs.select(
        F.struct(*[named(c) for c in others(docs, "shard", "slot")]).alias("row"),
        F.struct(*[named(c).alias(f"k{i}") for i, c in enumerate(key)]).alias("key"),
        F.coalesce(F.concat(F.lit("="), named(stratum).cast("string")), F.lit("")).alias("stratum"),
        shuffle_key(seed, [named(c) for c in key]).alias("h"),
        F.monotonically_increasing_id().alias("copy"),
    )
    base = materialize(base)  # so that ``copy`` stays what it is
    total = base.count()
    bits = _cell_bits(total)
    base = base.withColumn("cell", F.shiftright("h", 60 - bits))

    # 1. rank within the stratum
    most = max(HOT_ROWS, total >> HOT_BITS)
    hot = base.groupBy("stratum", "cell").count().filter(F.col("count") > most)  # at most 2 ** HOT_BITS cells
    hot = hot.select("stratum", "cell", F.ceil(F.col("count") / most).alias("parts"))
    base = base.join(F.broadcast(hot), ["stratum", "cell"], "left")
    base = base.withColumn("part", F.coalesce(F.pmod(F.xxhash64("copy"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    cell = ["stratum", "cell", "part"]
    within = Window.partitionBy("stratum")
    before = within.orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = base.groupBy(*cell).count().select(*cell, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(within).alias("n"))
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("h", "key", "copy"))
    ranked = base.withColumn("number", number).join(sizes, cell)
    share = (F.col("before") + F.col("number") - F.lit(0.5)) / F.col("n")
    ranked = materialize(ranked.select("row", "stratum", share.alias("share"), F.floor(share * F.lit(float(1 << bits))).alias("cell")))

    # 2. place among all rows; the cells are at most 2 ** MOST_BITS
    place = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("cell").count().select("cell", F.coalesce(F.sum("count").over(place), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("cell").orderBy("share", "stratum"))
    placed = ranked.withColumn("number", number).join(F.broadcast(sizes), "cell").withColumn("place", F.col("before") + F.col("number") - 1)
    placed = placed.withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}"))
    slot = F.col("place") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.select("row.*", F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, folder: str) -> None:
    """Parquet files in one folder a shard, each file a run of slots in order; a large shard has several, by several tasks."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
