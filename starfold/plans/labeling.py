"""Labeling jobs: products against catalogs of eclipses, transits and dispositions, each product with one status.

Products are rows (product_id, target_id, sector, start, stop, verified); catalog records meet them in one left join by
target, and everything else is an expression on the pair or one aggregation by product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators.cohort import map_disposition
from starfold.plans.freezing import valid_event

#: What the columns of events and labels say.
ECLIPSE, TRANSIT = "eclipse_like", "transit_like"
ECLIPSE_INSIDE = "primary_eclipse_ephemeris_overlaps_product_interval"
TRANSIT_INSIDE = "transit_window_overlaps_product_interval"
#: The class of each disposition in this job.
CLASSES = {"PC": TRANSIT, "KP": TRANSIT, "CP": TRANSIT, "EB": ECLIPSE, "V": "stellar_variability", "IS": "other_artifact"}


def _cycles(start: Column, epoch: Column, period: Column) -> Column:
    """The only cycles that can be an interval's first event: two at or before its start and the next one, which is in it or behind it."""
    first = F.floor((start - epoch) / period).cast("bigint") - 1
    return F.array(first, first + 1, first + 2)


def eclipse_events(products: DataFrame, records: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """A row for each product and record of its target, with the predicted primary eclipse or the reason why there is none.

    Records: (target_id, catalog, record_id, period, epoch, period_error, epoch_error, hours, sectors); null sectors say
    that the catalog has none, null errors and hours count as 0. An eclipse counts if it begins no later than the product stops
    and no earlier than half a duration plus ``sigmas`` uncertainties before it starts. Products without records have one row with null ones.
    """
    x = products.join(records, "target_id", "left")
    p, e, zero = F.col("period"), F.col("epoch"), F.lit(0.0)
    at = lambda n: e + n * p
    sigma = lambda n: F.hypot(F.coalesce("epoch_error", zero), F.abs(n) * F.coalesce("period_error", zero))
    early = lambda n: F.coalesce("hours", zero) / 48 + sigmas * sigma(n)
    hits = F.filter(_cycles(F.col("start"), e, p), lambda n: (at(n) <= F.col("stop")) & (at(n) >= F.col("start") - early(n)))
    status = (
        F.when(F.col("sectors").isNull(), "context_only_no_sector_evidence")
        .when(~F.array_contains("sectors", F.col("sector")), "product_sector_not_listed")
        .when(~F.col("verified") | F.col("start").isNull() | F.col("stop").isNull(), "product_interval_unavailable")
        .when(p.isNull() | e.isNull(), "catalog_primary_ephemeris_incomplete")
        .when((p > 0) & (F.size(hits) > 0), ECLIPSE_INSIDE)
        .otherwise("primary_eclipse_ephemeris_outside_product_interval")
    )
    x = x.withColumn("event_match_status", F.when(F.col("record_id").isNotNull(), status))
    cycle = F.when(F.col("event_match_status") == ECLIPSE_INSIDE, F.get(hits, F.lit(0)))
    return x.withColumn("cycle", cycle).withColumns({"event_time": at(F.col("cycle")), "sigma": sigma(F.col("cycle"))})


def label_eclipses(products: DataFrame, records: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """(product_id, label, label_status, records, sector_records, supports): one row a product; a product that is never an eclipse has no label, not a negative one."""
    x = eclipse_events(products, records, sigmas)
    listed = F.col("event_match_status").isNotNull() & ~F.col("event_match_status").isin("context_only_no_sector_evidence", "product_sector_not_listed")
    g = x.groupBy("product_id", "verified", (F.col("start").isNotNull() & F.col("stop").isNotNull()).alias("timed")).agg(
        F.count("record_id").alias("records"),
        F.count_if(listed).alias("sector_records"),
        F.count_if(F.col("event_match_status") == ECLIPSE_INSIDE).alias("supports"),
        F.count_if(F.col("event_match_status") == "context_only_no_sector_evidence").alias("context"),
    )
    status = (
        F.when(~F.col("verified"), "unlabeled_product_identity_or_interval_invalid")
        .when(F.col("records") == 0, "unlabeled_no_exact_tic_catalog_match")
        .when(F.col("supports") > 0, "catalog_primary_eclipse_in_sector_product_interval")
        .when((F.col("sector_records") > 0) & F.col("timed"), "unlabeled_catalog_primary_eclipse_outside_product_interval")
        .when(F.col("sector_records") > 0, "unlabeled_catalog_ephemeris_incomplete")
        .when(F.col("context") > 0, "unlabeled_catalog_context_without_sector_evidence")
        .otherwise("unlabeled_product_sector_not_listed_by_catalog")
    )
    g = g.withColumn("label_status", status)
    return g.select("product_id", F.when(F.col("label_status").startswith("catalog_"), ECLIPSE).alias("label"), "label_status", "records", "sector_records", "supports")


def transit_events(products: DataFrame, planets: DataFrame) -> DataFrame:
    """A row for each product and transiting planet of its host, with the first transit that meets the interval or the reason why there is none.

    Planets: (target_id, record_id, period, epoch, hours, period_bound, epoch_bound); the bounds are those of the printed
    digits, and a transit's window is widened by the epoch's bound and, for each cycle, the period's.
    """
    x = products.join(planets, "target_id", "left")
    p, e, half = F.col("period"), F.col("epoch"), F.col("hours") / 48
    at = lambda n: e + n * p
    bound = lambda n: F.col("epoch_bound") + F.abs(n) * F.col("period_bound")
    hits = F.filter(_cycles(F.col("start"), e, p), lambda n: (at(n) - half - bound(n) <= F.col("stop")) & (at(n) + half + bound(n) >= F.col("start")))
    status = (
        F.when(p.isNull() | e.isNull() | half.isNull(), "unlabeled_transit_ephemeris_incomplete")
        .when(~F.col("verified") | F.col("start").isNull() | F.col("stop").isNull(), "unlabeled_product_interval_unavailable")
        .when((p > 0) & (half > 0) & (F.size(hits) > 0), TRANSIT_INSIDE)
        .otherwise("transit_ephemeris_outside_product_interval")
    )
    x = x.withColumn("event_match_status", F.when(F.col("record_id").isNotNull(), status))
    cycle = F.when(F.col("event_match_status") == TRANSIT_INSIDE, F.get(hits, F.lit(0)))
    return x.withColumn("cycle", cycle).withColumns({"event_time": at(F.col("cycle")), "bound": bound(F.col("cycle"))})


def label_transits(products: DataFrame, planets: DataFrame) -> DataFrame:
    """(product_id, label, label_status, planets, supports): one row a product of a planet's host."""
    x = transit_events(products, planets)
    is_ = lambda s: F.col("event_match_status") == s
    g = x.groupBy("product_id", "verified").agg(F.count("record_id").alias("planets"), F.count_if(is_(TRANSIT_INSIDE)).alias("supports"), F.count_if(is_("unlabeled_transit_ephemeris_incomplete")).alias("incomplete"))
    status = (
        F.when(~F.col("verified"), "unlabeled_product_identity_or_interval_invalid")
        .when(F.col("planets") == 0, "unlabeled_host_has_no_confirmed_transiting_planet")
        .when(F.col("supports") > 0, "confirmed_transit_ephemeris_in_product_interval")
        .when(F.col("incomplete") > 0, "unlabeled_transit_ephemeris_incomplete")
        .otherwise("unlabeled_confirmed_transit_outside_product_interval")
    )
    g = g.withColumn("label_status", status)
    return g.select("product_id", F.when(F.col("label_status").startswith("confirmed_"), TRANSIT).alias("label"), "label_status", "planets", "supports")


def label_dispositions(products: DataFrame, dispositions: DataFrame, eclipses: DataFrame) -> DataFrame:
    """Labels by the dispositions of a product's own sector, beside its label by eclipses.

    Dispositions: (target_id, record_id, disposition, followup, sectors); ``eclipses`` has (product_id, label).
    (product_id, label, label_status, matches, same_sector, eclipse_label, cross_catalog_class_conflict).
    """
    known = dispositions.withColumn("m", map_disposition(F.col("disposition"), F.col("followup"), CLASSES)).select("target_id", "record_id", "sectors", F.col("m.label").alias("mapped"))
    here = F.coalesce(F.array_contains("sectors", F.col("sector")), F.lit(False))
    g = products.join(known, "target_id", "left").groupBy("product_id").agg(
        F.count("record_id").alias("matches"),
        F.count_if(here).alias("same_sector"),
        F.count_if(here & F.col("mapped").isNull()).alias("unclear"),
        F.min(F.when(here, F.col("mapped"))).alias("low"),
        F.max(F.when(here, F.col("mapped"))).alias("high"),
    )
    status = (
        F.when(F.col("matches") == 0, "unlabeled_no_toi_match")
        .when(F.col("same_sector") == 0, "unlabeled_toi_sector_not_listed")
        .when(F.col("low") != F.col("high"), "unlabeled_conflicting_toi_classes")
        .when(F.col("unclear") > 0, "unlabeled_ambiguous_or_unsupported_disposition")
        .otherwise("catalog_proxy_labeled")
    )
    g = g.withColumn("label_status", status).withColumn("label", F.when(F.col("label_status") == "catalog_proxy_labeled", F.col("low")))
    x = g.join(eclipses.select("product_id", F.col("label").alias("eclipse_label")), "product_id", "left")
    clash = F.coalesce(F.col("label") != F.col("eclipse_label"), F.lit(False))
    return x.select("product_id", "label", "label_status", "matches", "same_sector", "eclipse_label", clash.alias("cross_catalog_class_conflict"))


def printed_planets(archive: DataFrame, reference: str = "2457000") -> DataFrame:
    """Planets for ``transit_events`` from an archive's printed numbers: (target_id, record_id, period, epoch_bjd, hours), all text but the ids.

    The origin is taken off in decimal, before any rounding to binary; the bounds are half of the last printed digit
    of the period and of the epoch. Text that isn't a number is null, and so is its bound's planet's ephemeris.
    """
    number = lambda c: F.trim(F.col(c)).try_cast("decimal(38,18)")
    bound = lambda c: F.when(number(c).isNotNull(), S.rounding_uncertainty(F.col(c))).otherwise(0.0)
    return archive.select(
        "target_id", "record_id", number("period").cast("double").alias("period"), (number("epoch_bjd") - F.lit(reference).cast("decimal(38,18)")).cast("double").alias("epoch"),
        number("hours").cast("double").alias("hours"), bound("period").alias("period_bound"), bound("epoch_bjd").alias("epoch_bound"),
    )


def combined_labels(dispositions: DataFrame) -> DataFrame:
    """(product_id, label, label_status, eclipse_label, disposition_label): the two catalogs' labels of ``label_dispositions`` as one, with its status.

    Labels that differ leave the product without one.
    """
    e, t = F.col("eclipse_label"), F.col("label")
    status = (
        F.when(e != t, "unlabeled_conflicting_eb_and_toi_proxy_classes")
        .when(e.isNotNull() & t.isNotNull(), "both_catalog_overlays_same_class")
        .when(e.isNotNull(), "eb_catalog_proxy_only")
        .when(t.isNotNull(), "toi_catalog_proxy_only")
        .otherwise("unlabeled_in_both_catalog_overlays")
    )
    label = F.when(e.isNull() | t.isNull() | (e == t), F.coalesce(e, t))
    return dispositions.select("product_id", label.alias("label"), status.alias("label_status"), "eclipse_label", t.alias("disposition_label"))


def _events(rows: DataFrame, catalog: Column, label: str) -> DataFrame:
    event = valid_event(F.col("period"), F.col("epoch"), F.col("hours"))
    found = rows.select("product_id", F.lit(label).alias("class_label"), catalog.alias("catalog"), F.coalesce(F.col("record_id").cast("string"), F.lit("unknown")).alias("record_id"), event.alias("event"))
    return found.filter("event IS NOT NULL").select("product_id", "class_label", "catalog", "record_id", "event.*")


def event_records(transits: DataFrame, eclipses: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(product_id, class_label, catalog, record_id, period, epoch, hours): events that a cohort can be frozen with; epochs are those of the inputs.

    From ``transit_events`` and ``eclipse_events`` those inside their product's interval; from ``dispositions``
    (product_id, target_id, record_id, sector_match, disposition, followup, period, epoch, hours) planets in the product's sector. Events without a positive
    period or a finite epoch are none, and a duration of more than 48 hours is unknown.
    """
    a = _events(transits.filter(F.col("event_match_status") == TRANSIT_INSIDE), F.lit("confirmed_planets"), TRANSIT)
    b = _events(eclipses.filter(F.col("event_match_status") == ECLIPSE_INSIDE), F.concat(F.lit("eb:"), F.coalesce(F.col("catalog").cast("string"), F.lit("catalog"))), ECLIPSE)
    planet = map_disposition(F.col("disposition"), F.col("followup"), CLASSES)["label"] == TRANSIT
    c = _events(dispositions.filter(F.col("sector_match") & planet), F.lit("dispositions"), TRANSIT)
    return a.unionByName(b).unionByName(c).distinct()


def freeze_rows(labels: DataFrame, events: DataFrame, cohort: str) -> DataFrame:
    """Records for ``freezing.freeze``: labels (product_id, target_id, sha256, label) of a cohort with their events of the same class, null without one."""
    own = events.select("product_id", F.col("class_label").alias("label"), F.struct("catalog", "record_id", "period", "epoch", "hours").alias("event"))
    x = labels.join(own, ["product_id", "label"], "left")
    return x.select(F.lit(cohort).alias("cohort"), "product_id", "target_id", "sha256", "label", "event")
