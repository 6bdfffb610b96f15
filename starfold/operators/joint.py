"""Checks before a joint fit: each product's first fault, and whether the products of a target go together. No pair of products is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions.series import finite

#: A product's faults, in the order in which they are looked for, then those of a target.
PRODUCT_FAULTS = (
    "missing_product_id", "duplicate_product_id", "no_cadences", "not_finite", "not_normalized", "time_not_increasing",
    "exposure_not_positive", "exposure_exceeds_span", "exposures_overlap_within", "flux_error_invalid",
)
TARGET_FAULTS = ("fewer_than_two_products", "mixed_flux_error", "exposures_overlap_across")


def product_faults(cadences: DataFrame, products: DataFrame) -> DataFrame:
    """(target_id, product_id, n, with_error, fault): each product of ``products`` (target_id, product_id, exposure_days) with its first fault, or null.

    ``cadences`` has (target_id, product_id, cadence, time_days, flux, flux_error); ``cadence`` is the order in which times must rise strictly.
    Errors are all null, or all finite and positive. Fluxes are normalized if their median is within 5 % of 1.
    """
    by = ["target_id", "product_id"]
    step = F.col("time_days") - F.lag("time_days").over(Window.partitionBy(*by).orderBy("cadence"))
    good = finite(F.col("time_days")) & finite(F.col("flux"))
    error = F.col("flux_error")
    g = cadences.withColumn("_step", step).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("_odd"),
        F.median("flux").alias("_median"),
        F.min("_step").alias("_least"),
        (F.max("time_days") - F.min("time_days")).alias("_span"),
        F.count(error).alias("_errors"),
        F.count_if(error.isNotNull() & ~F.coalesce(finite(error) & (error > 0), F.lit(False))).alias("_bad"),
    )
    named = products.groupBy(*by).agg(F.count("*").alias("_times"), F.min("exposure_days").alias("_exposure"))
    x = named.join(g, by, "left")
    e, n, several = F.col("_exposure"), F.coalesce("n", F.lit(0)), F.col("n") > 1
    holds = [
        F.col("product_id").isNull() | (F.trim(F.col("product_id").cast("string")) == ""),
        F.col("_times") > 1,
        n == 0,
        F.col("_odd") > 0,
        ~F.col("_median").between(0.95, 1.05),
        F.col("_least") <= 0,
        ~F.coalesce(finite(e) & (e > 0), F.lit(False)),
        several & (e >= F.col("_span")),
        several & (F.col("_least") < e),
        (F.col("_bad") > 0) | ~F.col("_errors").isin(0) & (F.col("_errors") != n),
    ]
    fault: Column | None = None
    for name, is_so in zip(PRODUCT_FAULTS, holds, strict=True):
        fault = F.when(is_so, name) if fault is None else fault.when(is_so, name)
    return x.select(*by, n.alias("n"), (F.col("_errors") > 0).alias("with_error"), fault.alias("fault"))


def joint_status(cadences: DataFrame, products: DataFrame) -> DataFrame:
    """(target_id, products, product_id, status): ``valid``, or why a target's products can't be fitted together.

    A product's fault counts before those of the target's products together; of several products the first by id counts, and is named.
    Exposures overlap if one starts before the latest end of those that start no later: a running maximum in the order of starts.
    """
    faults = product_faults(cadences, products)
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("product_id", "fault")))
    g = faults.groupBy("target_id").agg(F.count("*").alias("products"), first.alias("_first"), F.count_if("with_error").alias("_with"))
    half = F.col("exposure_days") / 2
    spans = cadences.join(products.select("target_id", "product_id", "exposure_days"), ["target_id", "product_id"]).select("target_id", (F.col("time_days") - half).alias("s"), (F.col("time_days") + half).alias("e"))
    before = Window.partitionBy("target_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    crossing = spans.withColumn("_latest", F.max("e").over(before)).groupBy("target_id").agg(F.coalesce(F.bool_or(F.col("s") < F.col("_latest")), F.lit(False)).alias("_crosses"))
    status = (
        F.when(F.col("products") < 2, TARGET_FAULTS[0])
        .when(F.col("_first").isNotNull(), F.col("_first.fault"))
        .when((F.col("_with") > 0) & (F.col("_with") < F.col("products")), TARGET_FAULTS[1])
        .when(F.col("_crosses"), TARGET_FAULTS[2])
        .otherwise("valid")
    )
    x = g.join(crossing, "target_id", "left").withColumn("status", status)
    return x.select("target_id", "products", F.when(F.col("status") == F.col("_first.fault"), F.col("_first.product_id")).alias("product_id"), "status")


def event_coverage(cadences: DataFrame, ephemerides: DataFrame, exposures: DataFrame) -> DataFrame:
    """(target_id, product_id, status, cycles): whether a product can measure the events of (target_id, epoch, period, duration).

    ``fitted`` takes three cadences whose exposure meets an event and three that don't, ``no_event`` has none that does;
    ``cycles`` are the event numbers that it sees, from which the period needs two over all products.
    """
    x = cadences.join(ephemerides, "target_id").join(exposures, ["target_id", "product_id"])
    p = F.col("period")
    off = F.abs(F.pmod(F.col("time_days") - F.col("epoch") + p / 2, p) - p / 2)
    inside = off < (F.col("duration") + F.col("exposure_days")) / 2
    cycle = F.rint((F.col("time_days") - F.col("epoch")) / p).cast("bigint")
    g = x.groupBy("target_id", "product_id").agg(F.count_if(inside).alias("_in"), F.count_if(~inside).alias("_out"), F.array_sort(F.collect_set(F.when(inside, cycle))).alias("cycles"))
    status = F.when(F.col("_in") == 0, "no_event").when((F.col("_in") < 3) | (F.col("_out") < 3), "insufficient_data").otherwise("fitted")
    return g.select("target_id", "product_id", status.alias("status"), "cycles")
