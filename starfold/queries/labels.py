"""Queries of the labeling and freezing jobs: orders are products, customers their targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.operators import cohort as C
from starfold.plans import freezing as Z
from starfold.plans import labeling as L
from starfold.plans.freezing import merge_products
from starfold.queries import query
from starfold.queries.curves import rounded
from starfold.sources.tables import table

# The oracle walks the cycles one by one from two before the interval; the plan takes the first from a closed form.
TIMED_SQL = """prod AS (SELECT o_orderkey AS product_id, o_custkey AS target_id, 1 + o_orderkey % 13 AS sector, o_orderkey % 37 <> 0 AS verified,
  CASE WHEN o_orderkey % 37 <> 0 THEN date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 0.137::DOUBLE END AS start,
  CASE WHEN o_orderkey % 37 <> 0 THEN date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 4.637::DOUBLE END AS stop FROM orders)"""
RECORDS_SQL = """rec AS (SELECT c_custkey AS target_id, 'catalog' || k AS catalog, c_custkey * 3 + k AS record_id, CASE WHEN c_custkey % 11 <> k THEN 2.3::DOUBLE + c_custkey % 29 END AS period,
  3.1::DOUBLE + c_custkey % 17 + k AS epoch, CASE WHEN k = 1 THEN 0.0004::DOUBLE END AS period_error, 0.003::DOUBLE AS epoch_error, CASE WHEN k = 1 THEN 6.0::DOUBLE END AS hours,
  CASE WHEN k < 2 THEN [c_custkey % 7 + 1, c_custkey % 11 + 3] END AS sectors FROM customer, range(3) r(k) WHERE (c_custkey + k) % 4 > 0 AND c_custkey % 13 <> 0)"""
ECLIPSE_SQL = f"""{TIMED_SQL}, {RECORDS_SQL}, pair AS (SELECT * FROM prod LEFT JOIN rec USING (target_id)),
 walk AS (SELECT product_id, record_id, start, stop, epoch, period, hours, period_error, epoch_error, unnest(range(CAST(floor((start - epoch) / period) AS BIGINT) - 1, CAST(floor((stop - epoch) / period) AS BIGINT) + 2)) AS n FROM pair WHERE list_contains(sectors, sector) AND verified AND period IS NOT NULL),
 hit AS (SELECT product_id, record_id, min(n) AS cycle FROM walk WHERE epoch + n * period <= stop AND epoch + n * period >= start - coalesce(hours, 0) / 48 - 3 * sqrt(epoch_error ** 2 + (n * coalesce(period_error, 0)) ** 2) GROUP BY 1, 2),
 ev AS (SELECT pair.*, cycle, CASE WHEN record_id IS NULL THEN NULL WHEN sectors IS NULL THEN 'context_only_no_sector_evidence' WHEN NOT list_contains(sectors, sector) THEN 'product_sector_not_listed' WHEN NOT verified THEN 'product_interval_unavailable'
   WHEN period IS NULL THEN 'catalog_primary_ephemeris_incomplete' WHEN cycle IS NOT NULL THEN 'primary_eclipse_ephemeris_overlaps_product_interval' ELSE 'primary_eclipse_ephemeris_outside_product_interval' END AS event_match_status FROM pair LEFT JOIN hit USING (product_id, record_id)),
 ecl AS (SELECT product_id, any_value(verified) AS verified, count(record_id) AS records, count(*) FILTER (list_contains(sectors, sector)) AS sector_records, count(cycle) AS supports, count(*) FILTER (record_id IS NOT NULL AND sectors IS NULL) AS context FROM ev GROUP BY 1),
 ecl_label AS (SELECT product_id, records, sector_records, supports, CASE WHEN NOT verified THEN 'unlabeled_product_identity_or_interval_invalid' WHEN records = 0 THEN 'unlabeled_no_exact_tic_catalog_match' WHEN supports > 0 THEN 'catalog_primary_eclipse_in_sector_product_interval'
   WHEN sector_records > 0 THEN 'unlabeled_catalog_primary_eclipse_outside_product_interval' WHEN context > 0 THEN 'unlabeled_catalog_context_without_sector_evidence' ELSE 'unlabeled_product_sector_not_listed_by_catalog' END AS label_status,
   CASE WHEN verified AND supports > 0 THEN 'eclipse_like' END AS label FROM ecl)"""
PLANET_SQL = f"""{TIMED_SQL}, pl AS (SELECT c_custkey AS target_id, c_custkey * 2 + k AS record_id, 1.7::DOUBLE + c_custkey % 31 + k AS period, 2.2::DOUBLE + c_custkey % 19 AS epoch, CASE WHEN c_custkey % 9 <> k THEN 5.0::DOUBLE END AS hours,
  0.0005::DOUBLE AS period_bound, 0.05::DOUBLE AS epoch_bound FROM customer, range(2) r(k) WHERE c_custkey % 3 <> k),
 pair AS (SELECT * FROM prod LEFT JOIN pl USING (target_id)),
 walk AS (SELECT *, unnest(range(CAST(floor((start - epoch) / period) AS BIGINT) - 1, CAST(floor((stop - epoch) / period) AS BIGINT) + 3)) AS n FROM pair WHERE verified AND hours IS NOT NULL),
 hit AS (SELECT product_id, record_id, min(n) AS cycle FROM walk WHERE epoch + n * period - hours / 48 - (epoch_bound + abs(n) * period_bound) <= stop AND epoch + n * period + hours / 48 + epoch_bound + abs(n) * period_bound >= start GROUP BY 1, 2),
 ev AS (SELECT pair.*, cycle, CASE WHEN record_id IS NULL THEN NULL WHEN hours IS NULL THEN 'unlabeled_transit_ephemeris_incomplete' WHEN NOT verified THEN 'unlabeled_product_interval_unavailable' WHEN cycle IS NOT NULL THEN 'transit_window_overlaps_product_interval' ELSE 'transit_ephemeris_outside_product_interval' END AS event_match_status FROM pair LEFT JOIN hit USING (product_id, record_id)),
 tra AS (SELECT product_id, any_value(verified) AS verified, count(record_id) AS planets, count(cycle) AS supports, count(*) FILTER (record_id IS NOT NULL AND hours IS NULL) AS incomplete FROM ev GROUP BY 1),
 tra_label AS (SELECT product_id, planets, supports, CASE WHEN NOT verified THEN 'unlabeled_product_identity_or_interval_invalid' WHEN planets = 0 THEN 'unlabeled_host_has_no_confirmed_transiting_planet' WHEN supports > 0 THEN 'confirmed_transit_ephemeris_in_product_interval' WHEN incomplete > 0 THEN 'unlabeled_transit_ephemeris_incomplete' ELSE 'unlabeled_confirmed_transit_outside_product_interval' END AS label_status,
   CASE WHEN verified AND supports > 0 THEN 'transit_like' END AS label FROM tra)"""


def timed_products(spark, d):
    k, good = F.col("o_orderkey"), F.col("o_orderkey") % 37 != 0
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return table(spark, d, "orders").select(k.alias("product_id"), F.col("o_custkey").alias("target_id"), (1 + k % 13).alias("sector"), good.alias("verified"), F.when(good, day + 0.137).alias("start"), F.when(good, day + 4.637).alias("stop"))


def catalog_records(spark, d):
    c, k = F.col("c_custkey"), F.col("k")
    x = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).filter(((c + k) % 4 > 0) & (c % 13 != 0))
    return x.select(
        c.alias("target_id"),
        F.concat(F.lit("catalog"), k.cast("string")).alias("catalog"),
        (c * 3 + k).alias("record_id"),
        F.when(c % 11 != k, 2.3 + c % 29).alias("period"),
        (3.1 + c % 17 + k).alias("epoch"),
        F.when(k == 1, 0.0004).alias("period_error"),
        F.lit(0.003).alias("epoch_error"),
        F.when(k == 1, 6.0).alias("hours"),
        F.when(k < 2, F.array(c % 7 + 1, c % 11 + 3)).alias("sectors"),
    )


def planets(spark, d):
    c, k = F.col("c_custkey"), F.col("k")
    x = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")).filter(c % 3 != k)
    return x.select(c.alias("target_id"), (c * 2 + k).alias("record_id"), (1.7 + c % 31 + k).alias("period"), (2.2 + c % 19).alias("epoch"), F.when(c % 9 != k, 5.0).alias("hours"), F.lit(0.0005).alias("period_bound"), F.lit(0.05).alias("epoch_bound"))


@query(f"WITH {ECLIPSE_SQL} SELECT product_id, record_id, event_match_status, cycle, round(epoch + cycle * period, 6) AS event_time FROM ev")
def eclipse_events(spark, d):
    return rounded(L.eclipse_events(timed_products(spark, d), catalog_records(spark, d)).select("product_id", "record_id", "event_match_status", "cycle", "event_time"))


@query(f"WITH {ECLIPSE_SQL} SELECT product_id, label, label_status, records, sector_records, supports FROM ecl_label")
def label_eclipses(spark, d):
    return L.label_eclipses(timed_products(spark, d), catalog_records(spark, d))


@query(f"WITH {PLANET_SQL} SELECT product_id, record_id, event_match_status, cycle, round(epoch + cycle * period, 6) AS event_time FROM ev")
def transit_events(spark, d):
    return rounded(L.transit_events(timed_products(spark, d), planets(spark, d)).select("product_id", "record_id", "event_match_status", "cycle", "event_time"))


@query(f"WITH {PLANET_SQL} SELECT product_id, label, label_status, planets, supports FROM tra_label")
def label_transits(spark, d):
    return L.label_transits(timed_products(spark, d), planets(spark, d))


DISPOSITION_SQL = """dis AS (SELECT c_custkey AS target_id, c_custkey * 2 + k AS record_id, [c_custkey % 7 + 1 + k, c_custkey % 5 + 6] AS sectors, CASE WHEN (c_custkey + k) % 8 = 0 THEN 'zz' WHEN (c_custkey + k) % 8 < 5 THEN 'PC' ELSE 'EB' END AS disposition, CASE WHEN (c_custkey + k) % 6 = 0 THEN 'FP' WHEN (c_custkey + k) % 6 = 1 THEN 'CP' END AS followup FROM customer, range(2) r(k) WHERE c_custkey % 4 > k),
 mapped AS (SELECT *, CASE WHEN disposition = 'zz' OR followup = 'FP' OR (disposition = 'EB' AND followup = 'CP') THEN NULL WHEN disposition = 'PC' THEN 'transit_like' ELSE 'eclipse_like' END AS mapped FROM dis),
 near AS (SELECT product_id, count(record_id) AS matches, count(*) FILTER (list_contains(sectors, sector)) AS same_sector, count(*) FILTER (list_contains(sectors, sector) AND mapped IS NULL) AS unclear, list(DISTINCT mapped) FILTER (list_contains(sectors, sector) AND mapped IS NOT NULL) AS classes FROM prod LEFT JOIN mapped USING (target_id) GROUP BY 1),
 told AS (SELECT product_id, matches, same_sector, classes, CASE WHEN matches = 0 THEN 'unlabeled_no_toi_match' WHEN same_sector = 0 THEN 'unlabeled_toi_sector_not_listed' WHEN len(classes) > 1 THEN 'unlabeled_conflicting_toi_classes' WHEN unclear > 0 THEN 'unlabeled_ambiguous_or_unsupported_disposition' ELSE 'catalog_proxy_labeled' END AS label_status FROM near),
 toi AS (SELECT product_id, matches, same_sector, label_status, CASE WHEN label_status = 'catalog_proxy_labeled' THEN classes[1] END AS label FROM told)"""


@query(f"WITH {ECLIPSE_SQL}, {DISPOSITION_SQL} SELECT t.product_id, t.label, t.label_status, t.matches, t.same_sector, e.label AS eclipse_label, coalesce(t.label <> e.label, false) AS cross_catalog_class_conflict FROM toi t LEFT JOIN ecl_label e USING (product_id)")
def label_dispositions(spark, d):
    rows = dispositions(spark, d)
    return L.label_dispositions(timed_products(spark, d), rows, L.label_eclipses(timed_products(spark, d), catalog_records(spark, d)))


def dispositions(spark, d):
    c, k = F.col("c_custkey"), F.col("k")
    x = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")).filter(c % 4 > k)
    m, n = (c + k) % 8, (c + k) % 6
    return x.select(c.alias("target_id"), (c * 2 + k).alias("record_id"), F.array(c % 7 + 1 + k, c % 5 + 6).alias("sectors"), F.when(m == 0, "zz").when(m < 5, "PC").otherwise("EB").alias("disposition"), F.when(n == 0, "FP").when(n == 1, "CP").alias("followup"))


@query(f"""WITH {ECLIPSE_SQL}, {DISPOSITION_SQL} SELECT t.product_id, CASE WHEN t.label <> e.label THEN NULL ELSE coalesce(e.label, t.label) END AS label, CASE WHEN t.label <> e.label THEN 'unlabeled_conflicting_eb_and_toi_proxy_classes'
 WHEN t.label = e.label THEN 'both_catalog_overlays_same_class' WHEN e.label IS NOT NULL THEN 'eb_catalog_proxy_only' WHEN t.label IS NOT NULL THEN 'toi_catalog_proxy_only' ELSE 'unlabeled_in_both_catalog_overlays' END AS label_status,
 e.label AS eclipse_label, t.label AS disposition_label FROM toi t LEFT JOIN ecl_label e USING (product_id)""")
def combined_labels(spark, d):
    """Two catalogs' labels of each product as one."""
    return L.combined_labels(label_dispositions(spark, d))


EVENTS_OF_SQL = f"""found AS (SELECT product_id, 'transit_like' AS class_label, 'confirmed_planets' AS catalog, record_id, period, epoch, hours FROM (WITH {PLANET_SQL} SELECT * FROM ev) WHERE event_match_status = 'transit_window_overlaps_product_interval'
  UNION ALL SELECT product_id, 'eclipse_like', 'eb:' || coalesce(CAST(catalog AS VARCHAR), 'catalog'), record_id, period, epoch, hours FROM (WITH {ECLIPSE_SQL} SELECT * FROM ev) WHERE event_match_status = 'primary_eclipse_ephemeris_overlaps_product_interval'
  UNION ALL SELECT product_id, 'transit_like', 'dispositions', record_id, CASE WHEN record_id % 5 > 0 THEN 1.5::DOUBLE + record_id % 12 ELSE 0 END, 0.25::DOUBLE + record_id % 8, 3.0::DOUBLE * (record_id % 20) FROM (WITH {TIMED_SQL}, {DISPOSITION_SQL} SELECT prod.*, mapped.record_id, mapped FROM prod JOIN mapped USING (target_id) WHERE list_contains(sectors, sector)) WHERE mapped = 'transit_like'),
 events_of AS (SELECT DISTINCT product_id, class_label, catalog, CAST(record_id AS VARCHAR) AS record_id, period, epoch, CASE WHEN hours > 0 AND hours <= 48 THEN hours END AS hours FROM found WHERE period > 0 AND epoch IS NOT NULL)"""


def matched_events(spark, d):
    products, k = timed_products(spark, d), F.col("record_id")
    near = products.join(dispositions(spark, d), "target_id").withColumn("sector_match", F.array_contains("sectors", F.col("sector")))
    near = near.select("product_id", "target_id", "record_id", "sector_match", "disposition", "followup", F.when(k % 5 > 0, 1.5 + k % 12).otherwise(0.0).alias("period"), (0.25 + k % 8).alias("epoch"), (3.0 * (k % 20)).alias("hours"))
    return L.event_records(L.transit_events(products, planets(spark, d)), L.eclipse_events(products, catalog_records(spark, d)), near)


@query(f"WITH {EVENTS_OF_SQL} SELECT product_id, class_label, catalog, record_id, round(period, 9) AS period, round(epoch, 9) AS epoch, hours FROM events_of")
def event_records(spark, d):
    """Events of three catalogs that a cohort can be frozen with."""
    return rounded(matched_events(spark, d), 9)


@query(f"""WITH {EVENTS_OF_SQL}, tra AS (SELECT product_id, label FROM (WITH {PLANET_SQL} SELECT * FROM tra_label)), ecl AS (SELECT product_id, label FROM (WITH {ECLIPSE_SQL} SELECT * FROM ecl_label)),
 rows AS (SELECT product_id, label FROM tra UNION ALL SELECT product_id, label FROM ecl), g AS (SELECT product_id, min(label) AS label, min(label) <> max(label) AS clash FROM rows WHERE label IS NOT NULL GROUP BY 1),
 n AS (SELECT product_id, count(DISTINCT (class_label, catalog, record_id, period, epoch, hours)) AS events FROM events_of JOIN rows USING (product_id) WHERE class_label = rows.label GROUP BY 1)
 SELECT product_id, label, coalesce(events, 0) AS events, CASE WHEN clash THEN 'label_conflict' WHEN coalesce(events, 0) = 0 THEN 'no_valid_event_ephemeris' END AS reason FROM g LEFT JOIN n USING (product_id)""")
def merged_products(spark, d):
    """Labeled products of two cohorts with the events that they are frozen with."""
    events, owner = matched_events(spark, d), timed_products(spark, d).select("product_id", "target_id", F.sha2(F.col("product_id").cast("string"), 256).alias("sha256"))
    a = L.freeze_rows(label_transits(spark, d).join(owner, "product_id"), events, "hosts")
    b = L.freeze_rows(label_eclipses(spark, d).join(owner, "product_id"), events, "binaries")
    return merge_products(a.unionByName(b)).select("product_id", "label", "events", "reason")


# Planets as an archive prints them: periods with 1 to 4 decimals, some in scientific notation, epochs with 2 to 5, some texts that are no numbers.
PRINTED_SQL = PLANET_SQL.replace("""1.7::DOUBLE + c_custkey % 31 + k AS period, 2.2::DOUBLE + c_custkey % 19 AS epoch""", """CASE WHEN c_custkey % 23 <> 5 THEN (CAST((2 + c_custkey % 31 + k) * power(10, 1 + c_custkey % 4) AS BIGINT) + c_custkey % 7) / power(10, 1 + c_custkey % 4) END AS period,
  (CAST((3 + c_custkey % 19) * power(10, 2 + c_custkey % 4) AS BIGINT) + c_custkey % 9) / power(10, 2 + c_custkey % 4) AS epoch""").replace("0.0005::DOUBLE AS period_bound, 0.05::DOUBLE AS epoch_bound", "CASE WHEN c_custkey % 23 <> 5 THEN 0.5 * power(10, -(1 + c_custkey % 4)) ELSE 0 END AS period_bound, 0.5 * power(10, -(2 + c_custkey % 4)) AS epoch_bound").replace("WHERE verified AND hours IS NOT NULL)", "WHERE verified AND hours IS NOT NULL AND period IS NOT NULL)").replace("WHEN hours IS NULL THEN 'unlabeled_transit_ephemeris_incomplete'", "WHEN hours IS NULL OR period IS NULL THEN 'unlabeled_transit_ephemeris_incomplete'").replace("record_id IS NOT NULL AND hours IS NULL)", "record_id IS NOT NULL AND (hours IS NULL OR period IS NULL))")


def printed_archive(spark, d):
    """The numbers of ``PRINTED_SQL`` as text: digits put together, never printed from a double."""
    c, k = F.col("c_custkey"), F.col("k")
    x = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")).filter(c % 3 != k)

    def digits(whole, decimals, last, scientific):
        plain = F.concat(whole.cast("string"), F.lit("."), F.lpad(last.cast("string"), decimals, "0"))
        power = F.concat(whole.cast("string"), F.lpad(last.cast("string"), decimals, "0"), F.lit("E-"), decimals.cast("string"))
        return F.when(scientific, power).otherwise(plain)

    period = digits(2 + c % 31 + k, (1 + c % 4).cast("int"), c % 7, c % 5 == 0)
    epoch = digits(2457003 + c % 19, (2 + c % 4).cast("int"), c % 9, F.lit(False))
    return x.select(c.alias("target_id"), (c * 2 + k).alias("record_id"), F.when(c % 23 == 5, "unknown").otherwise(period).alias("period"), epoch.alias("epoch_bjd"), F.when(c % 9 != k, " 5.0 ").alias("hours"))


@query(f"WITH {PRINTED_SQL} SELECT target_id, record_id, round(period, 9) AS period, round(epoch, 9) AS epoch, hours, round(period_bound, 9) AS period_bound, round(epoch_bound, 9) AS epoch_bound FROM pl")
def printed_ephemerides(spark, d):
    """Periods, epochs and their bounds from printed digits."""
    return rounded(L.printed_planets(printed_archive(spark, d)), 9)


@query(f"WITH {PRINTED_SQL} SELECT product_id, record_id, event_match_status, cycle, round(epoch + cycle * period, 6) AS event_time FROM ev")
def printed_transit_events(spark, d):
    """Transits in intervals, each widened by what the printed digits leave open."""
    events = L.transit_events(timed_products(spark, d), L.printed_planets(printed_archive(spark, d)))
    return rounded(events.select("product_id", "record_id", "event_match_status", "cycle", "event_time"))


# Records of the freezing job: labels by eclipses and by transits, with their events; every 41st product lacks a checksum.
FREEZE_SQL = """rows AS (SELECT 'hosts' AS cohort, product_id, o_custkey AS target_id, label, CASE WHEN product_id % 41 <> 0 THEN 'sum' || product_id END AS sha256, CASE WHEN product_id % 10 > 0 THEN 'a' || product_id % 3 END AS event FROM {transits} JOIN orders ON o_orderkey = product_id
  UNION ALL SELECT 'binaries', product_id, o_custkey, label, CASE WHEN product_id % 41 <> 0 THEN 'sum' || product_id || CASE WHEN product_id % 29 = 0 THEN 'x' ELSE '' END END, CASE WHEN product_id % 7 > 0 THEN 'b' || product_id % 2 END FROM {eclipses} JOIN orders ON o_orderkey = product_id)"""


def freeze_records(spark, d):
    k = F.col("product_id")
    text = k.cast("string")
    target = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("target_id"))
    known = lambda name: F.when(k % 41 != 0, name)
    a = label_transits(spark, d).join(target, "product_id").select(F.lit("hosts").alias("cohort"), "product_id", "target_id", "label", known(F.concat(F.lit("sum"), text)).alias("sha256"), F.when(k % 10 > 0, F.concat(F.lit("a"), (k % 3).cast("string"))).alias("event"))
    b = label_eclipses(spark, d).join(target, "product_id").select(F.lit("binaries").alias("cohort"), "product_id", "target_id", "label", known(F.concat(F.lit("sum"), text, F.when(k % 29 == 0, "x").otherwise(""))).alias("sha256"), F.when(k % 7 > 0, F.concat(F.lit("b"), (k % 2).cast("string"))).alias("event"))
    return a.union(b)


def earlier(spark, d):
    o = table(spark, d, "orders")
    group = lambda n, split: o.filter(F.col("o_orderkey") % n == 0).select(F.col("o_custkey").cast("string").alias("source_group_id"), F.lit(split).alias("split"))
    prior = C.prior_partitions(group(50, "train"), group(70, "test"))
    return prior.select(F.col("source_group_id").cast("bigint").alias("target_id"), "splits")


EARLIER_SQL = "prior AS (SELECT o_custkey AS target_id, bool_or(o_orderkey % 70 = 0) AS tested FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 70 = 0 GROUP BY 1)"
FIRST = ECLIPSE_SQL.replace("ev AS", "ev1 AS").replace("FROM ev GROUP", "FROM ev1 GROUP")
SECOND = PLANET_SQL.split(", pl AS", 1)[1].replace("pair", "pair2").replace("walk", "walk2").replace("hit", "hit2").replace("ev AS", "ev2 AS").replace("FROM ev GROUP", "FROM ev2 GROUP")
DEAL_SQL = """h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('sequence:' || label || ':' || g), g) AS r, count(*) OVER (PARTITION BY label) AS n FROM src),
 part AS (SELECT DISTINCT label, n, name, pos, n * share AS ideal, CAST(floor(n * share + 1e-9) AS BIGINT) AS whole FROM h, (VALUES ('train', 1, 0.7::DOUBLE), ('calibration', 2, 0.1::DOUBLE), ('selection', 3, 0.1::DOUBLE), ('fresh_holdout', 4, 0.1::DOUBLE)) v(name, pos, share)),
 size AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY -round(ideal - whole, 6), name) <= n - sum(whole) OVER (PARTITION BY label) THEN 1 ELSE 0 END AS size FROM part),
 ends AS (SELECT label, name, sum(size) OVER (PARTITION BY label ORDER BY pos) AS last, sum(size) OVER (PARTITION BY label ORDER BY pos) - size AS first FROM size),
 dealt AS (SELECT g, h.label, name AS split FROM h JOIN ends ON h.label = ends.label AND r > first AND r <= last)"""


@query(f"""WITH {FIRST}, pl AS{SECOND}, {FREEZE_SQL.format(transits='tra_label', eclipses='ecl_label')}, {EARLIER_SQL},
 g AS (SELECT product_id, arg_min(target_id, cohort) AS target_id, arg_min(label, cohort) AS label, list_sort(list(DISTINCT cohort)) AS cohorts, count(DISTINCT event) AS events, count(DISTINCT label) AS labels, count(DISTINCT sha256) AS sums FROM rows WHERE label IS NOT NULL GROUP BY 1),
 m AS (SELECT *, CASE WHEN labels > 1 THEN 'label_conflict' WHEN sums > 1 THEN 'identity_or_checksum_conflict' WHEN sums = 0 THEN 'missing_product_sha256' WHEN events = 0 THEN 'no_valid_event_ephemeris' END AS reason FROM g),
 t AS (SELECT target_id, min(m.label) AS label, CASE WHEN count(DISTINCT m.label) > 1 THEN 'source_label_conflict' WHEN bool_or(tested) THEN 'prior_partition' END AS why, bool_or(tested) IS NOT NULL AS known FROM m LEFT JOIN prior USING (target_id) WHERE reason IS NULL GROUP BY 1),
 src AS (SELECT CAST(target_id AS VARCHAR) AS g, label FROM t WHERE why IS NULL AND NOT known), {DEAL_SQL}
 SELECT product_id, m.target_id, m.label, cohorts, events, coalesce(reason, why) AS reason, CASE WHEN coalesce(reason, why) IS NULL THEN CASE WHEN known THEN 'train' ELSE split END END AS split FROM m LEFT JOIN t USING (target_id) LEFT JOIN dealt ON g = CAST(m.target_id AS VARCHAR)""")
def cohort_job(spark, d):
    """The whole freezing job over two cohorts: every labeled product with its split or the reason why it has none."""
    return Z.freeze(freeze_records(spark, d), earlier(spark, d), "sequence")


@query(f"""WITH {EARLIER_SQL}, c AS (SELECT o_orderkey AS place, o_custkey AS target_id, CASE WHEN o_custkey % 6 > 0 THEN o_custkey // 2 END AS source, CASE WHEN o_custkey % 9 = 0 THEN o_orderstatus ELSE 'c' || o_custkey // 14 % 3 END AS label FROM orders),
 a AS (SELECT target_id, count(DISTINCT label) > 1 AS x FROM c GROUP BY 1), b AS (SELECT source, count(DISTINCT label) > 1 AS y FROM c WHERE source IS NOT NULL GROUP BY 1),
 w AS (SELECT c.*, tested, CASE WHEN x OR coalesce(y, false) THEN 'conflicting_classes' WHEN coalesce(tested, false) THEN 'prior_partition' END AS why FROM c JOIN a USING (target_id) LEFT JOIN b USING (source) LEFT JOIN prior USING (target_id)),
 f AS (SELECT source, min(place) AS first FROM w WHERE why IS NULL GROUP BY 1), r AS (SELECT w.*, coalesce(why, CASE WHEN place > first THEN 'duplicate_source' END) AS reason, coalesce('source-' || w.source, 'target-' || target_id) AS grp FROM w LEFT JOIN f ON w.source = f.source)
 SELECT place, target_id, label, reason, CASE WHEN reason IS NULL THEN CASE WHEN tested IS NULL AND CAST('0x' || substr(sha256('three:' || grp), 1, 8) AS BIGINT) % 5 = 0 THEN 'validation' ELSE 'train' END END AS split FROM r""")
def three_class_job(spark, d):
    """Sources of three classes under two catalogs' ids, with their fold or the reason why they have none."""
    k = F.col("o_custkey")
    label = F.when(k % 9 == 0, F.col("o_orderstatus")).otherwise(F.concat(F.lit("c"), (F.floor(k / 14) % 3).cast("string")))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), k.alias("target_id"), F.when(k % 6 > 0, F.floor(k / 2)).alias("source"), label.alias("label"))
    return Z.three_class_freeze(rows, earlier(spark, d), "three")
