"""Queries of studies and of smaller relational steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.operators import joint as J
from starfold.operators import studies as Y
from starfold.operators import transit as T
from starfold.queries import query
from starfold.queries.curves import FOLD_SQL, PARTS, lineitem_fold, lineitem_prep, rounded, supplier_candidates
from starfold.queries.searches import planted
from starfold.sources.tables import EVENTS_SQL, events_curve, table


@query()
def joint_fit(spark, d):
    """Cadences of odd and even lines as two products of one target."""
    products = planted(spark, d).withColumn("product_id", (F.col("cadence") % 2).cast("string"))
    c = supplier_candidates(spark, d).select("target_id", "epoch", "period", F.lit(0.015).alias("depth"), "duration")
    return Y.joint_fits(products, c)


@query()
def injection_trials(spark, d):
    """A trial for every customer, on a grid of periods and depths that their keys name."""
    k = F.col("c_custkey")
    trials = table(spark, d, "customer").select(k.alias("trial_id"), (1.7 + k % 5 * 0.9).alias("period"), (0.002 + k % 4 * 0.003).alias("depth"))
    return rounded(Y.injection_trials(trials, 12.0, 30, 0.001))


@query()
def band_power(spark, d):
    return Y.band_power(lineitem_prep(spark, d), "flux_norm")


@query()
def exposure_errors(spark, d):
    k = F.col("s_suppkey")
    cases = table(spark, d, "supplier").select(k.alias("case_id"), (2.0 + k % 9).alias("period"), (0.001 * (1 + k % 7)).alias("depth"), (0.1 + k % 5 * 0.05).alias("duration"), (0.0014 * (1 + k % 20)).alias("exposure"))
    return rounded(Y.exposure_errors(cases))


@query(FOLD_SQL + f""", {PARTS['centroid_shift']}, cr AS (SELECT target_id, max(crowding) AS crowding FROM fold GROUP BY 1),
 t1 AS (SELECT target_id, CASE WHEN centroid_shift_sigma > 3.5 AND shift_pixels > 0.2 THEN 'off_target' WHEN shift_pixels IS NULL OR crowding IS NULL OR crowding < 0.85 THEN 'unresolved' ELSE 'on_target' END AS a1 FROM f_centroid_shift JOIN cr USING (target_id)),
 t2 AS (SELECT s_suppkey AS target_id, CASE s_suppkey % 3 WHEN 0 THEN 'target_consistent' WHEN 1 THEN 'blend_suspected' END AS a2 FROM supplier)
 SELECT target_id, coalesce(a2, a1) AS assessment, CAST(CASE WHEN a2 IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS tier FROM t1 LEFT JOIN t2 USING (target_id)""")
def vetting_dispatch(spark, d):
    k = F.col("s_suppkey")
    second = table(spark, d, "supplier").select(k.alias("target_id"), F.when(k % 3 == 0, "target_consistent").when(k % 3 == 1, "blend_suspected").alias("assessment"))
    return Y.dispatch_vetting(T.vet_tier1(lineitem_fold(spark, d)), second)


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN p_size::DOUBLE WHEN p_size * (p_partkey % 3) > 0 THEN (p_size * (p_partkey % 3))::DOUBLE END AS seconds, CASE WHEN p_size % 5 = 0 THEN 'user_supplied' WHEN p_size * (p_partkey % 3) > 0 THEN 'frame_sum' ELSE 'missing' END AS source FROM part""")
def exposure_resolution(spark, d):
    e = Y.exposure_source(F.when(F.col("p_size") % 5 == 0, F.col("p_size")), F.col("p_size"), F.col("p_partkey") % 3)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), e.alias("e")).select("id", "e.*")


@query("SELECT l.doc_id, CASE WHEN lang IN ('en', 'de') THEN lang END AS class, quality::BIGINT AS quality FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def label_product_join(spark, d):
    """Labels with their product's class, null outside of the class list."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left")
    return x.select("doc_id", F.when(F.col("lang").isin("en", "de"), F.col("lang")).alias("class"), F.col("quality").cast("bigint").alias("quality"))


@query("SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n, count(*) FILTER (source LIKE 'src1%') AS from_src1 FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2")
def label_audit(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return x.groupBy(F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic")).agg(F.count("*").alias("n"), F.count_if(F.col("source").startswith("src1")).alias("from_src1"))


@query("SELECT o_orderkey AS product_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def known_target_exclusion(spark, d):
    known = table(spark, d, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    return table(spark, d, "orders").join(known, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("product_id"))


@query("SELECT o_custkey AS target_id, o_orderkey AS product_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)")
def unique_group_filter(spark, d):
    o = table(spark, d, "orders")
    single = o.groupBy("o_custkey").count().filter("count = 1").select("o_custkey")
    return o.join(single, "o_custkey", "left_semi").select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("product_id"))


@query("SELECT l_orderkey AS product_id, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS events FROM lineitem GROUP BY 1")
def event_reference_dedupe(spark, d):
    """Distinct event references of each product, in order."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("product_id")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("events"))


@query("WITH a AS (SELECT user_id AS g, 'left' AS s FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id AS g, 'right' AS s FROM events WHERE event_id % 3 = 0) SELECT DISTINCT a.g AS target_id FROM a JOIN b USING (g)")
def cross_partition_leak(spark, d):
    """Groups that two partitions share: none may be."""
    e = table(spark, d, "events")
    part = lambda n: e.filter(F.col("event_id") % n == 0).select(F.col("user_id").alias("target_id"))
    return part(2).intersect(part(3))


@query("SELECT user_id AS target_id, min(ts) FILTER (event_type = 'click') IS NOT NULL AS clicked, arg_max(event_id, value) AS best_event, round(max(value), 6) AS best_value FROM events GROUP BY 1")
def best_match_pick(spark, d):
    """The best of each target's matches by its score, the first of equal ones; a match without an id or a score is none."""
    e = table(spark, d, "events")
    score = F.when(F.col("event_id").isNotNull() & F.col("value").isNotNull(), F.struct("value", -F.col("event_id")))
    clicked = F.min(F.when(F.col("event_type") == "click", F.col("ts"))).isNotNull()
    return rounded(e.groupBy(F.col("user_id").alias("target_id")).agg(clicked.alias("clicked"), F.max_by("event_id", score).alias("best_event"), F.max("value").alias("best_value")))


@query("SELECT user_id AS target_id, event_type AS product_id, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT *, (epoch_us(ts) - 1704067200000000) / 86400e6 AS x FROM events) GROUP BY 1, 2 HAVING max(x) > min(x)")
def product_spans(spark, d):
    """Spans of products, whose pairwise overlaps are what unknown cadence widths fall back on."""
    c = events_curve(spark, d).groupBy("target_id", "product_id").agg(F.min("time_days").alias("low"), F.max("time_days").alias("high"))
    return rounded(c.filter("high > low"))


@query("""WITH s AS (SELECT user_id AS t, event_type AS p, min((epoch_us(ts) - 1704067200000000) / 86400e6) AS lo, max((epoch_us(ts) - 1704067200000000) / 86400e6) AS hi FROM events GROUP BY 1, 2)
 SELECT a.t AS target_id, a.p AS first, b.p AS second, round(greatest(a.lo, b.lo), 6) AS low, round(least(a.hi, b.hi), 6) AS high FROM s a JOIN s b ON a.t = b.t AND a.p < b.p AND a.lo <= b.hi AND b.lo <= a.hi""")
def span_intersection(spark, d):
    s = events_curve(spark, d).groupBy("target_id", F.col("product_id").alias("p")).agg(F.min("time_days").alias("lo"), F.max("time_days").alias("hi"))
    a, b = s.withColumnsRenamed({"p": "first", "lo": "alo", "hi": "ahi"}), s.withColumnsRenamed({"p": "second", "lo": "blo", "hi": "bhi"})
    x = a.join(b, "target_id").filter("first < second AND alo <= bhi AND blo <= ahi")
    return rounded(x.select("target_id", "first", "second", F.greatest("alo", "blo").alias("low"), F.least("ahi", "bhi").alias("high")))


# --- joint fits: products are a user's events of one kind, most of them fit to be fitted -----------

JOINT_SQL = f"""WITH {EVENTS_SQL}, cad AS (SELECT target_id, product_id, CASE WHEN target_id % 7 = 3 THEN cadence ELSE epoch_us(ts) END AS cadence, time_days,
   CASE WHEN target_id % 8 = 5 THEN flux ELSE 1 + (flux - floor(flux)) / 100 END AS flux, CASE WHEN target_id % 9 = 4 AND product_id = 'click' THEN NULL WHEN target_id % 10 = 6 AND quality = 3 THEN 0.0 WHEN target_id % 5 > 0 THEN 0.1 END AS flux_error
   FROM curve JOIN events ON event_id = cadence),
 kinds AS (SELECT DISTINCT target_id, product_id FROM cad WHERE target_id % 6 <> 1 OR product_id = 'click'),
 prod AS (SELECT target_id, product_id, CASE WHEN target_id % 11 = 2 THEN 0.0 WHEN target_id % 12 = 7 THEN 2.0 WHEN target_id % 13 = 9 THEN 40.0 WHEN target_id % 2 = 0 THEN 0.0001 ELSE 0.02 END AS exposure_days FROM kinds
   UNION ALL SELECT target_id, 'zoom', 0.001 FROM kinds WHERE target_id % 17 = 3 GROUP BY 1 UNION ALL SELECT target_id, product_id, 0.0001 FROM kinds WHERE target_id % 19 = 8 AND product_id = 'click'),
 step AS (SELECT *, time_days - lag(time_days) OVER (PARTITION BY target_id, product_id ORDER BY cadence) AS step FROM cad),
 g AS (SELECT target_id, product_id, count(*) AS n, count(*) FILTER (NOT isfinite(time_days) OR NOT isfinite(flux)) AS odd, median(flux) AS mid, min(step) AS least, max(time_days) - min(time_days) AS span, count(flux_error) AS errors,
   count(*) FILTER (flux_error IS NOT NULL AND NOT (isfinite(flux_error) AND flux_error > 0)) AS bad FROM step GROUP BY 1, 2),
 named AS (SELECT target_id, product_id, count(*) AS times, min(exposure_days) AS e FROM prod GROUP BY 1, 2),
 fault AS (SELECT target_id, product_id, coalesce(n, 0) AS n, errors > 0 AS with_error, CASE WHEN times > 1 THEN 'duplicate_product_id' WHEN n IS NULL THEN 'no_cadences' WHEN odd > 0 THEN 'not_finite' WHEN mid NOT BETWEEN 0.95 AND 1.05 THEN 'not_normalized'
   WHEN least <= 0 THEN 'time_not_increasing' WHEN e IS NULL OR NOT e > 0 THEN 'exposure_not_positive' WHEN n > 1 AND e >= span THEN 'exposure_exceeds_span' WHEN n > 1 AND least < e THEN 'exposures_overlap_within'
   WHEN bad > 0 OR errors NOT IN (0, n) THEN 'flux_error_invalid' END AS fault FROM named LEFT JOIN g USING (target_id, product_id))"""


def joint_inputs(spark, d):
    k, kind = F.col("target_id"), F.col("product_id")
    e = table(spark, d, "events").select(F.col("event_id").alias("cadence"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    cad = events_curve(spark, d).join(e, "cadence").select(
        k, kind, F.when(k % 7 == 3, F.col("cadence")).otherwise(F.col("us")).alias("cadence"), "time_days", F.when(k % 8 == 5, F.col("flux")).otherwise(1 + (F.col("flux") - F.floor("flux")) / 100).alias("flux"),
        F.when((k % 9 == 4) & (kind == "click"), None).when((k % 10 == 6) & (F.col("quality") == 3), 0.0).when(k % 5 > 0, 0.1).alias("flux_error"),
    )
    kinds = cad.select(k, kind).distinct().filter((k % 6 != 1) | (kind == "click"))
    exposure = F.when(k % 11 == 2, 0.0).when(k % 12 == 7, 2.0).when(k % 13 == 9, 40.0).when(k % 2 == 0, 0.0001).otherwise(0.02)
    more = kinds.filter(k % 17 == 3).select(k, F.lit("zoom"), F.lit(0.001)).distinct()
    twice = kinds.filter((k % 19 == 8) & (kind == "click")).select(k, kind, F.lit(0.0001))
    return cad, kinds.select(k, kind, exposure.alias("exposure_days")).union(more).union(twice)


@query(JOINT_SQL + " SELECT * FROM fault")
def joint_product_faults(spark, d):
    return J.product_faults(*joint_inputs(spark, d))


@query(JOINT_SQL + """, t AS (SELECT target_id, count(*) AS products, min({'product_id': product_id, 'fault': fault}) FILTER (fault IS NOT NULL) AS first, count(*) FILTER (with_error) AS with_error FROM fault GROUP BY 1),
 spans AS (SELECT c.target_id, row_number() OVER () AS id, time_days - exposure_days / 2 AS s, time_days + exposure_days / 2 AS e FROM cad c JOIN prod USING (target_id, product_id)),
 crossing AS (SELECT DISTINCT a.target_id FROM spans a JOIN spans b ON a.target_id = b.target_id AND a.id <> b.id AND a.s < b.e AND b.s < a.e),
 x AS (SELECT t.*, CASE WHEN products < 2 THEN 'fewer_than_two_products' WHEN first IS NOT NULL THEN first.fault WHEN with_error > 0 AND with_error < products THEN 'mixed_flux_error' WHEN c.target_id IS NOT NULL THEN 'exposures_overlap_across' ELSE 'valid' END AS status FROM t LEFT JOIN crossing c ON c.target_id = t.target_id)
 SELECT target_id, products, CASE WHEN status = first.fault THEN first.product_id END AS product_id, status FROM x""")
def joint_validation(spark, d):
    """The SQL compares all pairs of exposures; the query keeps a running maximum."""
    return J.joint_status(*joint_inputs(spark, d))


@query(JOINT_SQL + """, e AS (SELECT c_custkey AS target_id, 0.5 + c_custkey % 4 AS epoch, 3.0 + c_custkey % 6 AS period, 0.4::DOUBLE AS duration FROM customer),
 x AS (SELECT c.target_id, c.product_id, time_days, epoch, period, abs((time_days - epoch + period / 2) - period * floor((time_days - epoch + period / 2) / period) - period / 2) < (duration + exposure_days) / 2 AS inside FROM cad c JOIN e USING (target_id) JOIN (SELECT target_id, product_id, min(exposure_days) AS exposure_days FROM prod GROUP BY 1, 2) p USING (target_id, product_id)),
 cov AS (SELECT target_id, product_id, count(*) FILTER (inside) AS i, count(*) FILTER (NOT inside) AS o, coalesce(list_sort(list(DISTINCT CAST(round_even((time_days - epoch) / period, 0) AS BIGINT)) FILTER (inside)), []) AS c FROM x GROUP BY 1, 2)
 SELECT target_id, product_id, CASE WHEN i = 0 THEN 'no_event' WHEN i < 3 OR o < 3 THEN 'insufficient_data' ELSE 'fitted' END AS status, CAST(len(c) AS BIGINT) AS cycles, array_to_string(c, ',') AS seen FROM cov""")
def joint_coverage(spark, d):
    cad, prod = joint_inputs(spark, d)
    k = F.col("c_custkey")
    e = table(spark, d, "customer").select(k.alias("target_id"), (0.5 + k % 4).alias("epoch"), (3.0 + k % 6).alias("period"), F.lit(0.4).alias("duration"))
    x = J.event_coverage(cad, e, prod.groupBy("target_id", "product_id").agg(F.min("exposure_days").alias("exposure_days")))
    return x.select("target_id", "product_id", "status", F.size("cycles").cast("bigint").alias("cycles"), F.array_join(F.col("cycles").cast("array<string>"), ",").alias("seen"))
