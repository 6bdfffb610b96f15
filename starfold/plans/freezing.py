"""Cohorts frozen from labeled products: merging, conflicts, earlier partitions, splits; every product keeps the reason if it is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators.cohort import stable_partition
from starfold.session import materialize

#: The shares of the splits, in the order in which they are dealt, and the classes.
SPLITS = (("train", 0.7), ("calibration", 0.1), ("selection", 0.1), ("fresh_holdout", 0.1))
CLASSES = ("transit_like", "eclipse_like")


def valid_event(period: Column, epoch: Column, hours: Column) -> Column:
    """(period, epoch, hours) of an event, or null: a positive period and a finite epoch; a duration that isn't within 48 hours is unknown."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = finite(period) & (period > 0) & finite(epoch)
    return F.when(good, F.struct(period.alias("period"), epoch.alias("epoch"), F.when(finite(hours) & (hours > 0) & (hours <= 48), hours).alias("hours")))


def merge_products(records: DataFrame) -> DataFrame:
    """One row a product of all cohorts that list it, with ``reason`` null or why it is left out.

    Records: (cohort, product_id, target_id, sha256, label, event); one row for each event, whose null says that the record has none.
    Labels outside of the classes are no records. A product takes its columns from the first cohort by name.
    """
    g = records.filter(F.col("label").isin(*CLASSES)).groupBy("product_id").agg(
        F.min_by("target_id", "cohort").alias("target_id"),
        F.min_by("label", "cohort").alias("label"),
        F.min("sha256").alias("sha256"),
        F.array_sort(F.collect_set("cohort")).alias("cohorts"),
        F.count_distinct("event").alias("events"),
        (F.min("label") != F.max("label")).alias("_labels"),
        ((F.min("target_id") != F.max("target_id")) | F.coalesce(F.min("sha256") != F.max("sha256"), F.lit(False))).alias("_identity"),
    )
    reason = (
        F.when(F.col("_labels"), "label_conflict")
        .when(F.col("_identity"), "identity_or_checksum_conflict")
        .when(F.col("sha256").isNull(), "missing_product_sha256")
        .when(F.col("events") == 0, "no_valid_event_ephemeris")
    )
    return g.withColumn("reason", reason).drop("_labels", "_identity")


def freeze(records: DataFrame, prior: DataFrame, seed: str) -> DataFrame:
    """Products with their split, or the reason why they have none.

    ``prior`` has (target_id, splits): targets that were only ever in train stay there, those in another split are left out.
    New targets are dealt within each class by ``stable_partition``. Targets with products of both classes are left out whole.
    """
    merged = materialize(merge_products(records))  # labels and all behind them once, not once for each use
    clean = F.col("reason").isNull()
    by_target = merged.filter(clean).groupBy("target_id").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    targets = by_target.join(prior.select("target_id", F.col("splits").alias("_prior")), "target_id", "left")
    known = F.when(F.col("_low") != F.col("_high"), "source_label_conflict").when(F.array_except("_prior", F.array(F.lit("train"))) != F.array().cast("array<string>"), "prior_partition")
    targets = targets.select("target_id", F.col("_low").alias("_label"), known.alias("_why"), F.when(F.size("_prior") > 0, "train").alias("_old"))
    dealt = stable_partition(targets.filter("_why IS NULL AND _old IS NULL").select("target_id", "_label"), "target_id", "_label", seed, SPLITS)
    placed = targets.join(dealt.select("target_id", F.col("split").alias("_new")), "target_id", "left")
    x = merged.join(placed, "target_id", "left")
    why = F.coalesce(F.col("reason"), F.col("_why"))
    return x.select("product_id", "target_id", "label", "cohorts", "events", why.alias("reason"), F.when(why.isNull(), F.coalesce("_old", "_new")).alias("split"))


def three_class_freeze(candidates: DataFrame, prior: DataFrame, seed: str, validation: int = 5) -> DataFrame:
    """Sources of three classes with their fold, or the reason why they have none.

    Candidates: (place, target_id, source, label), ``place`` being their order; ``source`` is a second catalog's id or null.
    Sources with several classes are left out, also over the second catalog's id; then those that an earlier
    partition other than train has; then later ones of the same second id. Known training sources stay in train, and every
    ``validation``-th group by a salted hash is validation.
    """
    group = F.coalesce(F.concat(F.lit("source-"), F.col("source").cast("string")), F.concat(F.lit("target-"), F.col("target_id").cast("string")))
    x = candidates.withColumn("group", group)
    several = lambda key: x.groupBy(key).agg((F.min("label") != F.max("label")).alias(f"_{key}"))
    x = x.join(several("target_id"), "target_id").join(several("group"), "group").join(prior.select("target_id", F.col("splits").alias("_prior")), "target_id", "left")
    other = F.coalesce(F.exists("_prior", lambda s: s != "train"), F.lit(False))
    x = x.withColumn("_why", F.when(F.col("_target_id") | F.col("_group"), "conflicting_classes").when(other, "prior_partition"))
    firsts = x.filter("_why IS NULL AND source IS NOT NULL").groupBy("group").agg(F.min("place").alias("_first"))
    x = x.join(firsts, "group", "left")
    x = x.withColumn("reason", F.coalesce("_why", F.when(F.col("place") > F.col("_first"), "duplicate_source")))
    held = (S.hash_number(F.concat(F.lit(f"{seed}:"), F.col("group"))) % validation == 0) & ~F.coalesce(F.size("_prior") > 0, F.lit(False))
    return x.select("place", "target_id", "label", "reason", F.when(F.col("reason").isNull(), F.when(held, "validation").otherwise("train")).alias("split"))
