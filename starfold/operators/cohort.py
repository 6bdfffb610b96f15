"""Catalog cross-matching, interval joins, conflict removal, partitions and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import series as S

#: Catalog dispositions and the class that each stands for; follow-up dispositions that confirm or reject.
CLASS_OF = {"PC": "transit_like", "CP": "transit_like", "KP": "transit_like", "EB": "eclipsing_binary", "V": "variability"}
CONFIRMING, REJECTING = ("PC", "CP", "KP"), ("APC", "FP", "FA")


def map_disposition(first: Column, second: Column, classes: dict[str, str] = CLASS_OF) -> Column:
    """(label, status) of a catalog's disposition and its follow-up's."""
    a, b = F.upper(F.trim(first)), F.coalesce(F.upper(F.trim(second)), F.lit(""))
    label = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])[a]
    out = lambda name, status: F.struct(F.lit(name).cast("string").alias("label") if not isinstance(name, Column) else name.alias("label"), F.lit(status).alias("status"))
    return (
        F.when(label.isNull(), out(None, "unsupported_tess_disposition"))
        .when(b.isin(*REJECTING), out(None, "ambiguous_or_false_positive_followup"))
        .when((b != "") & ((label == "transit_like") != b.isin(*CONFIRMING)), out(None, "conflicting_followup_disposition"))
        .otherwise(out(label, "clear_same_event_catalog_proxy"))
    )


def sector_match(products: DataFrame, catalog: DataFrame, on: str, sector: str, sectors: str) -> DataFrame:
    """Products with the catalog rows of the same id whose sector list holds the product's sector."""
    return products.join(catalog, on).filter(F.array_contains(F.col(sectors), F.col(sector)))


def unanimous_label(matches: DataFrame, product: str) -> DataFrame:
    """One label a product if all of its matches have a label and agree; else the reason."""
    g = matches.groupBy(product).agg(F.collect_set("label").alias("labels"), F.bool_or(F.col("label").isNull()).alias("unclear"), F.count("*").alias("matches"))
    n = F.size("labels")
    status = F.when(n == 0, "no_clear_label").when(F.col("unclear"), "partly_unclear").when(n > 1, "conflicting_labels").otherwise("labeled")
    return g.select(product, "matches", status.alias("label_status"), F.when(status == "labeled", F.col("labels")[0]).alias("label"))


def events_in_intervals(events: DataFrame, intervals: DataFrame, on: str, sigmas: float = 0.0) -> DataFrame:
    """First event of each periodic ephemeris that meets each interval of the same id.

    Events have ``epoch, period, duration`` and the uncertainties ``epoch_error, period_error``;
    intervals have ``start, stop``. With ``sigmas`` an event n is uncertain by sigmas * hypot of
    the two, n times the second; without, by their sum, n times the second. The first cycle is
    reached in closed form, so a pair needs a few cycles unless its uncertainty is larger than its period;
    then it needs as many as fit into the uncertainty, without a bound.
    """
    pairs = events.join(intervals, on)
    # the earliest cycle that can reach the interval with the widest uncertainty among those tried
    first = F.floor((F.col("start") - F.col("epoch")) / F.col("period")).cast("bigint") - 1
    slack = F.col("epoch_error") + (F.abs(first) + 2) * F.col("period_error")
    begin = first - F.ceil((F.col("duration") / 2 + F.greatest(F.lit(1.0), F.lit(sigmas)) * slack) / F.col("period")).cast("bigint")
    end = F.floor((F.col("stop") - F.col("epoch")) / F.col("period")).cast("bigint") + (first - begin) + 1
    x = pairs.filter((F.col("period") > 0) & (F.col("duration") > 0)).withColumn("cycle", F.explode(F.sequence(begin, end)))
    n = F.abs("cycle")
    bound = sigmas * F.hypot(F.col("epoch_error"), n * F.col("period_error")) if sigmas else F.col("epoch_error") + n * F.col("period_error")
    at = F.col("epoch") + F.col("cycle") * F.col("period")
    x = x.withColumns({"event_time": at, "bound": bound})
    half = F.col("duration") / 2  # taken off before the bound: at an interval's very end another order rounds to the other side
    hit = x.filter((F.col("event_time") - half - F.col("bound") <= F.col("stop")) & (F.col("event_time") + half + F.col("bound") >= F.col("start")))
    keys = [c for c in pairs.columns if c not in ("epoch", "period", "duration", "epoch_error", "period_error")]
    return hit.groupBy(*keys).agg(F.min_by(F.struct("cycle", "event_time", "bound"), "cycle").alias("e")).select(*keys, "e.cycle", "e.event_time", "e.bound")


def match_ephemeris(period: Column, epoch: Column, true_period: Column, true_epoch: Column, true_hours: Column, tolerance: float = 0.01) -> Column:
    """(matched, is_primary, is_harmonic): the period within the tolerance at once, half or twice, and the epoch within the event."""
    near = lambda k: F.abs(period - k * true_period) / (k * true_period) <= tolerance
    off = F.abs(S.phase_days(epoch, true_epoch, true_period))
    close = off <= F.greatest(F.lit(0.05), 1.25 * true_hours / 24)
    good = (true_period > 0) & (period > 0) & close
    primary = good & near(1.0)
    harmonic = good & (near(0.5) | near(2.0)) & ~near(1.0)
    return F.struct((primary | harmonic).alias("matched"), primary.alias("is_primary"), harmonic.alias("is_harmonic"))


def alias_match(period: Column, reference: Column, tolerance: float = 0.02) -> Column:
    return F.exists(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), lambda k: F.abs(period / (k * reference) - 1) <= tolerance)


def overlay_labels(first: DataFrame, second: DataFrame, product: str) -> DataFrame:
    """Two labels of each product as one; a disagreement has no label and a conflict mark."""
    x = first.select(product, F.col("label").alias("a")).join(second.select(product, F.col("label").alias("b")), product, "full")
    clash = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    return x.select(product, F.when(~clash, F.coalesce("a", "b")).alias("label"), clash.alias("cross_catalog_class_conflict"))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).filter("values > 1")


def without_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.join(conflicts(rows, key, value), key, "left_anti")


def prior_partitions(*assignments: DataFrame) -> DataFrame:
    """All splits that earlier assignments gave each group."""
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b), assignments)
    return rows.select(F.regexp_replace("source_group_id", "^tic-", "").alias("source_group_id"), "split").groupBy("source_group_id").agg(F.array_sort(F.collect_set("split")).alias("splits"))


#: Shares of the splits, in the order in which they are dealt.
SHARES = (("train", 0.7), ("validation", 0.1), ("calibration", 0.1), ("test", 0.1))


def stable_partition(groups: DataFrame, group: str, label: str, seed: str, shares: tuple[tuple[str, float], ...] = SHARES) -> DataFrame:
    """Deal the groups of each label to the splits, in the order of a salted hash, by largest remainders.

    Splits end at ranks, and ranks come from counts of hash ranges, so no label is sorted in one task: ranks
    within a range of the hash's first digits add to the counts of the ranges before it.
    """
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(label), F.col(group)), 256)
    rows = groups.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    ranges = rows.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    before = ranges.withColumn("_before", F.sum("_n").over(Window.partitionBy(label).orderBy("_range")) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy(label)))
    rank = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", group)) + F.col("_before")
    x = rows.join(before, [label, "_range"]).withColumn("_rank", rank)
    whole = [F.floor(F.col("_total") * share + 1e-9).cast("bigint") for _, share in shares]
    rest = F.col("_total") - sum(whole[1:], whole[0])
    part = [F.round(F.col("_total") * share - w, 6) for (_, share), w in zip(shares, whole, strict=True)]
    order = F.transform(F.array_sort(F.array(*[F.struct((-p).alias("p"), F.lit(name).alias("name")) for p, (name, _) in zip(part, shares, strict=True)])), lambda s: s["name"])
    extra = [F.when(F.array_position(order, name) <= rest, 1).otherwise(0) for name, _ in shares]
    split, end = None, F.lit(0)
    for (name, _), w, e in zip(shares, whole, extra, strict=True):
        end = end + w + e
        split = F.when(F.col("_rank") <= end, name) if split is None else split.when(F.col("_rank") <= end, name)
    return x.select(group, label, split.alias("split"))


def hash_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The ``n`` keys of smallest salted hash: the same ones whatever the order of rows."""
    return rows.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("_h").limit(n).drop("_h")


def quota_per_class(rows: DataFrame, key: str, label: str, seed: str, n: int) -> DataFrame:
    """Up to ``n`` rows of each class in the order of a salted hash."""
    w = Window.partitionBy(label).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the order columns."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_x")).select(key, "_x.*")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with the side that has them."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def content_id(entries: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The id of each manifest: 16 digits of the hash of its sorted entries. A manifest lists one target's products."""
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))), "\n")
    return entries.groupBy(by).agg(F.substring(F.sha2(text, 256), 1, 16).alias("manifest_id"), F.count("*").alias("entries"))
