"""Queries that write the tables' curves as FITS products into the shared folder and read them through the data source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.operators import gates
from starfold.plans.labeling import label_transits
from starfold.queries import query
from starfold.session import shared_folder
from starfold.sources import fits_source, publish
from starfold.sources.tables import EVENTS_SQL, events_curve, table


def products(spark, d) -> DataFrame:
    """Each user's events of one type as one product; users with an id that 5 divides have no sector."""
    sector = F.when(F.col("target_id") % 5 != 0, F.col("target_id") % 60)
    return events_curve(spark, d).select(
        F.col("target_id").cast("string").alias("target_id"), F.concat_ws("_", "target_id", F.concat("product_id", F.lit("_lc.fits"))).alias("product_id"), sector.cast("int").alias("sector"),
        "cadence", "time_days", "flux", (F.abs("flux") / 100).alias("flux_error"), "quality",
    )


PRODUCTS_SQL = EVENTS_SQL + """, products AS (SELECT CAST(target_id AS VARCHAR) AS target_id, target_id || '_' || product_id || '_lc.fits' AS product_id,
 CAST(CASE WHEN target_id % 5 <> 0 THEN target_id % 60 END AS INTEGER) AS sector, cadence, time_days, flux, abs(flux) / 100 AS flux_error, quality FROM curve)"""


def exported(spark, d):
    """(reader, path) of the products' files."""
    path = f"{shared_folder(spark)}/fits-{uuid.uuid4().hex}"
    fits_source.write_products(products(spark, d), path).agg(F.sum("n_rows")).collect()
    return fits_source.register(spark).read.format("fits"), path


@query(f"""WITH {PRODUCTS_SQL} SELECT product_id, target_id, sector, 'SAP_FLUX' AS flux_kind, 2457000.0::DOUBLE AS time_reference, count(*) AS n, round(sum(time_days), 6) AS time_sum,
 round(sum(flux), 4) AS flux_sum, round(sum(flux_error), 4) AS error_sum, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS quality_sum, CAST(sum(cadence) AS BIGINT) AS cadence_sum FROM products GROUP BY ALL""")
def fits_cadences(spark, d):
    """All cadences of all files: what was written is read."""
    read, path = exported(spark, d)
    keys = ["product_id", "target_id", "sector", "flux_kind", "time_reference"]
    return read.load(path).groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.sum("time_days"), 6).alias("time_sum"), F.round(F.sum("flux"), 4).alias("flux_sum"),
        F.round(F.sum("flux_error"), 4).alias("error_sum"), F.sum("quality").alias("quality_sum"), F.sum("cadence").alias("cadence_sum"),
    )


@query(f"""WITH {PRODUCTS_SQL} SELECT product_id, target_id, sector, count(*) AS n_rows, min(time_days) AS time_start, max(time_days) AS time_stop, 'd' AS time_unit, 'TDB' AS time_system,
 CAST(NULL AS VARCHAR) AS error FROM products WHERE sector = 7 OR sector = 8 GROUP BY ALL""")
def fits_headers(spark, d):
    """A header scan with a filter that files decide before anything else is read."""
    read, path = exported(spark, d)
    schema = "product_id string, target_id string, sector int, n_rows long, time_start double, time_stop double, time_unit string, time_system string, error string"
    return read.option("rows", "files").option("timeAxis", "days").schema(schema).load(path).filter(F.col("sector").isin(7, 8))


INVENTORY_SQL = PRODUCTS_SQL + """, inventory AS (SELECT product_id, any_value(target_id) AS target_id, any_value(sector) AS sector, min(time_days) AS start, max(time_days) AS stop FROM products GROUP BY 1),
 stated AS (SELECT product_id, CASE WHEN target_id::INT % 7 = 0 THEN target_id || '0' ELSE target_id END AS target_id, CASE WHEN target_id::INT % 11 = 0 THEN 99 ELSE coalesce(sector, 0) END AS sector FROM inventory
   UNION ALL SELECT 'gone_' || product_id, target_id, sector FROM inventory WHERE sector = 1)"""


def stated(spark, d) -> DataFrame:
    """An inventory in which some targets, some sectors and some files are wrong."""
    p = products(spark, d).select("product_id", "target_id", "sector").distinct()
    k = F.col("target_id").cast("int")
    wrong = p.select("product_id", F.when(k % 7 == 0, F.concat("target_id", F.lit("0"))).otherwise(F.col("target_id")).alias("target_id"), F.when(k % 11 == 0, 99).otherwise(F.coalesce("sector", F.lit(0))).alias("sector"))
    return wrong.union(p.filter("sector = 1").select(F.concat(F.lit("gone_"), "product_id").alias("product_id"), "target_id", "sector"))


@query(f"""WITH {INVENTORY_SQL}, x AS (SELECT s.product_id, s.target_id, s.sector, i.start, i.stop, CASE WHEN i.product_id IS NULL THEN 'file_missing' WHEN i.target_id <> s.target_id THEN 'tic_mismatch'
 WHEN i.sector IS DISTINCT FROM s.sector THEN 'sector_mismatch' END AS fault FROM stated s LEFT JOIN inventory i ON i.product_id = s.product_id)
 SELECT product_id, target_id, CAST(sector AS INTEGER) AS sector, CASE WHEN fault IS NULL THEN start END AS start, CASE WHEN fault IS NULL THEN stop END AS stop, fault IS NULL AS verified, fault FROM x""")
def fits_intervals(spark, d):
    """Each product of an inventory with its interval from its file's headers, or why it has none."""
    read, path = exported(spark, d)
    return fits_source.product_intervals(read.option("rows", "files").load(path), stated(spark, d))


@query(f"""WITH {INVENTORY_SQL} SELECT product_id, CASE WHEN i.product_id IS NULL THEN 'file_missing' WHEN s.product_id IS NULL THEN 'unexpected' WHEN i.target_id <> s.target_id THEN 'tic_mismatch'
 WHEN i.sector IS DISTINCT FROM s.sector THEN 'sector_mismatch' ELSE 'verified' END AS verdict FROM (SELECT product_id, target_id, CASE WHEN sector > 0 THEN sector END AS sector FROM stated WHERE target_id::INT % 13 <> 0) s FULL JOIN inventory i USING (product_id)""")
def fits_verification(spark, d):
    """Files against what an acquisition should have brought."""
    read, path = exported(spark, d)
    expected = stated(spark, d).filter(F.col("target_id").cast("int") % 13 != 0)
    expected = expected.select("product_id", "target_id", F.when(F.col("sector") > 0, F.col("sector")).alias("sector"), F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("string").alias("sha256"))
    schema = f"{fits_source.HEADER}, {fits_source.WHOLE_FILE}"
    return fits_source.verify_products(read.schema(schema).option("rows", "files").load(path), expected).select("product_id", "verdict")


@query(f"""WITH {INVENTORY_SQL}, planets AS (SELECT CAST(s_suppkey AS VARCHAR) AS target_id, s_suppkey AS record_id, 3.0 + s_suppkey % 17 AS period, s_suppkey % 29 - 100.0 AS epoch, 2.0 + s_suppkey % 5 AS hours FROM supplier),
 p AS (SELECT s.product_id, s.target_id, CASE WHEN i.target_id = s.target_id AND i.sector IS NOT DISTINCT FROM s.sector THEN i.start END AS start, i.stop FROM stated s LEFT JOIN inventory i USING (product_id)),
 hits AS (SELECT p.product_id, bool_or(x.n IS NOT NULL) AS hit FROM p JOIN planets q USING (target_id) LEFT JOIN (SELECT unnest(range(-10, 80)) AS n) x
   ON epoch + n * period - hours / 48 <= stop AND epoch + n * period + hours / 48 >= start GROUP BY 1)
 SELECT p.product_id, CASE WHEN start IS NOT NULL AND hit THEN 'transit_like' END AS label, CASE WHEN start IS NULL THEN 'unlabeled_product_identity_or_interval_invalid' WHEN hit IS NULL THEN 'unlabeled_host_has_no_confirmed_transiting_planet'
 WHEN hit THEN 'confirmed_transit_ephemeris_in_product_interval' ELSE 'unlabeled_confirmed_transit_outside_product_interval' END AS label_status FROM p LEFT JOIN hits USING (product_id)""")
def fits_labels(spark, d):
    """From files to labels: intervals of the headers meet the transits of the suppliers' ephemerides."""
    read, path = exported(spark, d)
    k = F.col("s_suppkey")
    zero = F.lit(0.0)
    planets = table(spark, d, "supplier").select(k.cast("string").alias("target_id"), k.alias("record_id"), (3.0 + k % 17).alias("period"), (k % 29 - 100.0).alias("epoch"), (2.0 + k % 5).alias("hours"), zero.alias("period_bound"), zero.alias("epoch_bound"))
    intervals = fits_source.product_intervals(read.option("rows", "files").load(path), stated(spark, d))
    return label_transits(intervals, planets).select("product_id", "label", "label_status")


@query("SELECT o_orderkey AS product_id, CAST(o_custkey AS VARCHAR) AS target_id, 1 + o_orderkey % 13 AS sector, 'same' AS again, 'refused' AS changed FROM orders")
def frozen_inventory(spark, d):
    """An inventory is frozen; found again in another order it is the same, and with a row changed it is refused."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("product_id"), F.col("o_custkey").cast("string").alias("target_id"), (1 + k % 13).alias("sector"), F.current_timestamp().alias("found_at"))
    target = f"{shared_folder(spark)}/frozen-{uuid.uuid4().hex}"
    first = publish.freeze(rows, target, leave_out=["found_at"])
    again = "same" if publish.freeze(rows.orderBy(F.desc("product_id")), target) == first else "differs"
    try:
        publish.freeze(rows.withColumn("sector", F.when(F.col("product_id") == 1, 99).otherwise(F.col("sector"))), target)
        changed = "accepted"
    except publish.FrozenDiffers:
        changed = "refused"
    return publish.read_frozen(spark, target).drop("found_at").withColumns({"again": F.lit(again), "changed": F.lit(changed)})


@query(f"WITH {PRODUCTS_SQL} SELECT product_id, target_id, count(*) AS n, round(max(time_days), 6) AS last FROM products GROUP BY ALL")
def gated_products(spark, d):
    """Gates on single rows, on neighbours and on repeats in front of an aggregation."""
    x = products(spark, d)
    x = gates.require_rows(x, a_time=F.col("time_days").isNotNull(), a_flux=F.col("flux").isNotNull())
    x = gates.strictly_increasing(gates.unique(x, "product_id", "cadence"), ["product_id"], "time_days", "time_days")
    return x.groupBy("product_id", "target_id").agg(F.count("*").alias("n"), F.round(F.max("time_days"), 6).alias("last"))
