"""Queries on catalogs, intervals, conflicts, partitions and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators import cohort as C
from starfold.queries import query
from starfold.queries.curves import rounded
from starfold.sources.tables import table

# Products are orders, the catalog is the customers: a customer's sectors are listed as text.
SECTORS = "concat_ws(',', c_custkey % 7 + 1, c_custkey % 11 + 3, 'x', '900')"
PRODUCTS_SQL = "prod AS (SELECT o_orderkey AS product_id, o_custkey AS target_id, 1 + o_orderkey % 13 AS sector, CASE o_orderstatus WHEN 'F' THEN 'EB' WHEN 'O' THEN 'PC' ELSE 'XX' END AS first, CASE o_orderpriority WHEN '1-URGENT' THEN 'FP' WHEN '2-HIGH' THEN 'cp ' WHEN '3-MEDIUM' THEN '' END AS second, o_orderdate FROM orders)"
DISPOSED_SQL = """disp AS (SELECT *, CASE WHEN first = 'XX' THEN 'unsupported_tess_disposition' WHEN upper(trim(coalesce(second, ''))) IN ('APC', 'FP', 'FA') THEN 'ambiguous_or_false_positive_followup'
 WHEN coalesce(upper(trim(second)), '') <> '' AND (first = 'PC') <> (upper(trim(second)) IN ('PC', 'CP', 'KP')) THEN 'conflicting_followup_disposition' ELSE 'clear_same_event_catalog_proxy' END AS status FROM prod),
 lab AS (SELECT *, CASE WHEN status = 'clear_same_event_catalog_proxy' THEN CASE first WHEN 'PC' THEN 'transit_like' ELSE 'eclipsing_binary' END END AS label FROM disp)"""


def products(spark, d):
    o = table(spark, d, "orders")
    first = F.when(F.col("o_orderstatus") == "F", "EB").when(F.col("o_orderstatus") == "O", "PC").otherwise("XX")
    second = F.when(F.col("o_orderpriority") == "1-URGENT", "FP").when(F.col("o_orderpriority") == "2-HIGH", "cp ").when(F.col("o_orderpriority") == "3-MEDIUM", "")
    return o.select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("target_id"), (1 + F.col("o_orderkey") % 13).alias("sector"), first.alias("first"), second.alias("second"), "o_orderdate")


def labeled(spark, d):
    return products(spark, d).withColumn("m", C.map_disposition(F.col("first"), F.col("second"))).select("*", "m.label", "m.status").drop("m")


@query(f"WITH {PRODUCTS_SQL}, {DISPOSED_SQL} SELECT product_id, label, status FROM lab")
def disposition_label(spark, d):
    return labeled(spark, d).select("product_id", "label", "status")


@query(f"WITH {PRODUCTS_SQL} SELECT product_id, target_id, sector FROM prod JOIN customer ON c_custkey = target_id WHERE sector = c_custkey % 7 + 1 OR sector = c_custkey % 11 + 3")
def catalog_sector_match(spark, d):
    catalog = table(spark, d, "customer").select(F.col("c_custkey").alias("target_id"), S.sector_list(F.expr(SECTORS)).alias("sectors"))
    return C.sector_match(products(spark, d), catalog, "target_id", "sector", "sectors").select("product_id", "target_id", "sector")


@query("SELECT c_custkey AS id, list_sort(list_distinct([c_custkey % 7 + 1, c_custkey % 11 + 3])) AS sectors FROM customer")
def sector_list_parse(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.transform(S.sector_list(F.expr(SECTORS)), lambda x: x.cast("bigint")).alias("sectors"))


@query(f"""WITH {PRODUCTS_SQL}, {DISPOSED_SQL}, g AS (SELECT target_id, count(*) AS matches, count(DISTINCT label) AS n, bool_or(label IS NULL) AS unclear, min(label) AS one FROM lab GROUP BY 1)
 SELECT target_id, matches, CASE WHEN n = 0 THEN 'no_clear_label' WHEN unclear THEN 'partly_unclear' WHEN n > 1 THEN 'conflicting_labels' ELSE 'labeled' END AS label_status, CASE WHEN n = 1 AND NOT unclear THEN one END AS label FROM g""")
def catalog_crossmatch(spark, d):
    return C.unanimous_label(labeled(spark, d), "target_id")


INTERVAL_SQL = """ev AS (SELECT c_custkey AS target_id, 3.1::DOUBLE + c_custkey % 17 AS epoch, 5.37::DOUBLE + c_custkey % 29 AS period, 0.2::DOUBLE AS duration, 0.003::DOUBLE AS epoch_error, 0.0004::DOUBLE AS period_error FROM customer),
 iv AS (SELECT o_orderkey AS product_id, o_custkey AS target_id, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 0.137::DOUBLE AS start, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 4.637::DOUBLE AS stop FROM orders),
 cy AS (SELECT ev.*, product_id, start, stop, unnest(range(CAST(floor((start - epoch) / period) AS BIGINT) - 3, CAST(floor((stop - epoch) / period) AS BIGINT) + 4)) AS cycle FROM ev JOIN iv USING (target_id)),
 hit AS (SELECT *, epoch + cycle * period AS event_at, {bound} AS bound FROM cy WHERE epoch + cycle * period - 0.1 - ({bound}) <= stop AND epoch + cycle * period + 0.1 + ({bound}) >= start)
 SELECT target_id, product_id, min(cycle) AS cycle, round(arg_min(event_at, cycle), 6) AS event_time, round(arg_min(bound, cycle), 6) AS bound FROM hit GROUP BY 1, 2"""


def _interval_inputs(spark, d):
    k, day = F.col("c_custkey"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    events = table(spark, d, "customer").select(k.alias("target_id"), (3.1 + k % 17).alias("epoch"), (5.37 + k % 29).alias("period"), F.lit(0.2).alias("duration"), F.lit(0.003).alias("epoch_error"), F.lit(0.0004).alias("period_error"))
    intervals = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_custkey").alias("target_id"), (day + 0.137).alias("start"), (day + 4.637).alias("stop"))
    return events, intervals


@query("WITH " + INTERVAL_SQL.format(bound="epoch_error + abs(cycle) * period_error"))
def interval_event_match(spark, d):
    return rounded(C.events_in_intervals(*_interval_inputs(spark, d), "target_id").drop("start", "stop"))


@query("WITH " + INTERVAL_SQL.format(bound="3 * sqrt(epoch_error * epoch_error + cycle * cycle * period_error * period_error)"))
def interval_event_match_sigma(spark, d):
    return rounded(C.events_in_intervals(*_interval_inputs(spark, d), "target_id", sigmas=3.0).drop("start", "stop"))


@query("""WITH c AS (SELECT c_custkey AS id, 2.0::DOUBLE + c_custkey % 9 AS tp, (2.0::DOUBLE + c_custkey % 9) * CASE c_custkey % 4 WHEN 0 THEN 1.003 WHEN 1 THEN 0.5 WHEN 2 THEN 2.01 ELSE 1.4 END AS p, 1.0::DOUBLE + (c_custkey % 10) * 0.031 AS e, 1.0::DOUBLE AS te, 3.0::DOUBLE AS h FROM customer),
 x AS (SELECT *, abs(e - te + tp / 2 - tp * floor((e - te + tp / 2) / tp) - tp / 2) <= greatest(0.05, 1.25 * h / 24) AS near, abs(p - tp) / tp <= 0.01 AS one, abs(p - 0.5 * tp) / (0.5 * tp) <= 0.01 OR abs(p - 2 * tp) / (2 * tp) <= 0.01 AS alias FROM c)
 SELECT id, near AND (one OR alias) AS matched, near AND one AS is_primary, near AND alias AND NOT one AS is_harmonic FROM x""")
def ephemeris_match(spark, d):
    k = F.col("c_custkey")
    tp = 2.0 + k % 9
    p = tp * F.when(k % 4 == 0, 1.003).when(k % 4 == 1, 0.5).when(k % 4 == 2, 2.01).otherwise(1.4)
    m = C.match_ephemeris(p, 1.0 + k % 10 * 0.031, tp, F.lit(1.0), F.lit(3.0))
    return table(spark, d, "customer").select(k.alias("id"), m.alias("m")).select("id", "m.*")


@query("""SELECT c_custkey AS id, abs(p / (0.5 * q) - 1) <= 0.02 OR abs(p / q - 1) <= 0.02 OR abs(p / (2 * q) - 1) <= 0.02 AS alias FROM (SELECT c_custkey, 1.0::DOUBLE + c_custkey % 23 AS p, 2.0::DOUBLE + c_custkey % 7 AS q FROM customer)""")
def period_alias_match(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), C.alias_match(1.0 + k % 23, 2.0 + k % 7).alias("alias"))


@query(f"""WITH {PRODUCTS_SQL}, {DISPOSED_SQL}, a AS (SELECT product_id, label FROM lab WHERE product_id % 3 > 0), b AS (SELECT product_id, CASE WHEN sector > 6 THEN 'transit_like' ELSE 'eclipsing_binary' END AS label FROM prod WHERE product_id % 2 = 0)
 SELECT product_id, CASE WHEN NOT (a.label IS NOT NULL AND b.label IS NOT NULL AND a.label <> b.label) THEN coalesce(a.label, b.label) END AS label, (a.label IS NOT NULL AND b.label IS NOT NULL AND a.label <> b.label) AS cross_catalog_class_conflict FROM a FULL JOIN b USING (product_id)""")
def overlay_conflicts(spark, d):
    rows = labeled(spark, d)
    first = rows.filter("product_id % 3 > 0").select("product_id", "label")
    second = rows.filter("product_id % 2 = 0").select("product_id", F.when(F.col("sector") > 6, "transit_like").otherwise("eclipsing_binary").alias("label"))
    return C.overlay_labels(first, second, "product_id")


@query("SELECT l_partkey AS product_id, count(DISTINCT l_suppkey) AS values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def product_conflicts(spark, d):
    return C.conflicts(table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), "l_suppkey"), "product_id", "l_suppkey")


@query(f"WITH {PRODUCTS_SQL}, {DISPOSED_SQL} SELECT product_id, target_id, label FROM lab WHERE label IS NOT NULL AND target_id NOT IN (SELECT target_id FROM lab WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1)")
def source_conflicts(spark, d):
    """Labeled products of sources without contradicting labels."""
    return C.without_conflicts(labeled(spark, d).filter("label IS NOT NULL"), "target_id", "label").select("product_id", "target_id", "label")


@query("""WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS g, 'train' AS s FROM orders WHERE o_orderkey % 5 = 0 UNION SELECT CAST(o_custkey AS VARCHAR), 'test' FROM orders WHERE o_orderkey % 7 = 0), k AS (SELECT g AS source_group_id, list_sort(list(DISTINCT s)) AS splits FROM a GROUP BY 1)
 SELECT c_custkey AS target_id, coalesce(array_to_string(splits, '+'), 'new') AS prior FROM customer LEFT JOIN k ON source_group_id = CAST(c_custkey AS VARCHAR)""")
def prior_partition_exclusion(spark, d):
    o = table(spark, d, "orders")
    group = lambda n, split: o.filter(F.col("o_orderkey") % n == 0).select(F.concat(F.lit("tic-"), F.col("o_custkey").cast("string")).alias("source_group_id"), F.lit(split).alias("split"))
    prior = C.prior_partitions(group(5, "train"), group(7, "test"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("target_id"), F.col("c_custkey").cast("string").alias("source_group_id"))
    return c.join(prior, "source_group_id", "left").select("target_id", F.coalesce(F.array_join("splits", "+"), F.lit("new")).alias("prior"))


SPLIT_SQL = """h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('cohort:' || label || ':' || g), g) AS r, count(*) OVER (PARTITION BY label) AS n FROM src),
 w AS (SELECT *, [{'name': 'train', 'x': n * 0.7::DOUBLE}, {'name': 'validation', 'x': n * 0.1::DOUBLE}, {'name': 'calibration', 'x': n * 0.1::DOUBLE}, {'name': 'test', 'x': n * 0.1::DOUBLE}] AS ideal FROM h),
 v AS (SELECT *, list_transform(ideal, lambda s: {'p': -round(s.x - floor(s.x + 1e-9), 6), 'name': s.name}) AS parts, n - CAST(list_sum(list_transform(ideal, lambda s: floor(s.x + 1e-9))) AS BIGINT) AS rest FROM w),
 u AS (SELECT *, list_transform(list_sort(parts), lambda s: s.name) AS ord FROM v),
 e AS (SELECT *, list_transform(ideal, lambda s: CAST(floor(s.x + 1e-9) AS BIGINT) + CASE WHEN list_position(ord, s.name) <= rest THEN 1 ELSE 0 END) AS sizes FROM u),
 dealt AS (SELECT g, label, CASE WHEN r <= sizes[1] THEN 'train' WHEN r <= sizes[1] + sizes[2] THEN 'validation' WHEN r <= sizes[1] + sizes[2] + sizes[3] THEN 'calibration' ELSE 'test' END AS split FROM e)"""


@query(f"WITH src AS (SELECT CAST(c_custkey AS VARCHAR) AS g, c_mktsegment AS label FROM customer), {SPLIT_SQL} SELECT g AS source_group_id, label, split FROM dealt")
def stable_partition(spark, d):
    groups = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("source_group_id"), F.col("c_mktsegment").alias("label"))
    return C.stable_partition(groups, "source_group_id", "label", "cohort")


@query(f"""WITH {PRODUCTS_SQL}, {DISPOSED_SQL}, ok AS (SELECT * FROM lab WHERE label IS NOT NULL AND target_id NOT IN (SELECT target_id FROM lab WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1)),
 fresh AS (SELECT * FROM ok WHERE target_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)), src AS (SELECT DISTINCT CAST(target_id AS VARCHAR) AS g, label FROM fresh), {SPLIT_SQL}
 SELECT product_id, target_id, fresh.label, split FROM fresh JOIN dealt ON g = CAST(target_id AS VARCHAR)""")
def cohort_freeze(spark, d):
    """The flagship relational job: labels, conflicts, earlier holdouts, splits."""
    ok = C.without_conflicts(labeled(spark, d).filter("label IS NOT NULL"), "target_id", "label")
    held = table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("target_id"))
    fresh = ok.join(held, "target_id", "left_anti").withColumn("g", F.col("target_id").cast("string"))
    dealt = C.stable_partition(fresh.select("g", "label").distinct(), "g", "label", "cohort").select("g", "split")
    return fresh.join(dealt, "g").select("product_id", "target_id", "label", "split")


@query("SELECT doc_id FROM documents ORDER BY sha256('corpus:' || doc_id) LIMIT 100")
def hash_sample(spark, d):
    """A sampling operator: the hundred smallest salted hashes."""
    return C.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", "corpus", 100)


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('quota:' || doc_id)) <= 20")
def quota_per_class(spark, d):
    return C.quota_per_class(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", "quota", 20)


@query("SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold FROM documents")
def hash_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", (S.hash_number(F.col("doc_id").cast("string")) % 5).alias("fold"))


@query("SELECT o_custkey AS target_id, o_orderkey AS product_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_product(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("product_id"), "o_orderdate")
    return C.latest(o, "target_id", "o_orderdate", "product_id").select("target_id", "product_id")


@query("SELECT o_custkey AS target_id, substr(sha256(string_agg(o_orderkey || '|' || o_orderstatus, chr(10) ORDER BY o_orderkey || '|' || o_orderstatus)), 1, 16) AS manifest_id, count(*) AS entries FROM orders GROUP BY 1")
def manifest_id(spark, d):
    """A manifest for each target's products."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "target_id")
    return C.content_id(o, "target_id", ["o_orderkey", "o_orderstatus"])


@query("SELECT o_orderkey AS product_id, 'left' AS side FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'right' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def inventory_difference(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"))
    return C.difference(o.filter("product_id % 3 = 0"), o.filter("product_id % 2 = 0"))


@query("SELECT doc_id, sha256(text) AS actual, (doc_id % 9 <> 0 AND text IS NOT NULL) AS intact FROM documents")
def integrity_check(spark, d):
    """Hashes of components against those recorded; every ninth record is damaged."""
    x = table(spark, d, "documents").withColumn("actual", F.sha2("text", 256))
    recorded = F.when(F.col("doc_id") % 9 == 0, F.sha2(F.lit("damaged"), 256)).otherwise(F.sha2(F.encode("text", "UTF-8"), 256))
    return x.select("doc_id", "actual", F.coalesce(F.col("actual") == recorded, F.lit(False)).alias("intact"))


@query("""SELECT o_orderkey AS task_id, sha256(o_clerk || ':' || o_orderstatus || ':model:3') AS cache_key FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS o_clerk FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def cache_lookup(spark, d):
    """Tasks whose result isn't cached, with their cache key."""
    o = table(spark, d, "orders").withColumn("cache_key", F.sha2(F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderstatus", F.lit("model"), F.lit("3")), 256))
    cached = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(cached, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("task_id"), "cache_key")


@query("SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 200")
def task_queue_page(spark, d):
    """A page of a queue: the limit is the feature."""
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").offset(200).limit(100).select(F.col("o_orderkey").alias("task_id"))


@query("SELECT o_custkey AS job_id, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS failed, round(count(*) FILTER (o_orderstatus <> 'O') / count(*)::DOUBLE, 6) AS progress FROM orders GROUP BY 1")
def job_progress(spark, d):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return rounded(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(n("F").alias("completed"), n("O").alias("pending"), n("P").alias("failed"), (F.count_if(F.col("o_orderstatus") != "O") / F.count("*")).alias("progress")))


@query("""SELECT s_suppkey AS a, CAST(n_nationkey AS BIGINT) AS b, round(degrees(2 * asin(sqrt(least(1, sin(radians(d2 - d1) / 2) ** 2 + cos(radians(d1)) * cos(radians(d2)) * sin(radians(r2 - r1) / 2) ** 2)))), 6) AS degrees
 FROM (SELECT s_suppkey, n_nationkey, s_suppkey % 360 AS r1, s_suppkey % 170 - 85 AS d1, n_nationkey * 14 AS r2, n_nationkey * 6 - 80 AS d2 FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def sky_separation(spark, d):
    x = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    return rounded(x.select(s.alias("a"), n.alias("b"), S.sky_separation(s % 360, s % 170 - 85, n * 14, n * 6 - 80).alias("degrees")))


@query("""SELECT o_orderkey AS id, CASE WHEN regexp_full_match(regexp_replace(t, '\\.0$', ''), '\\d+') THEN regexp_replace(t, '\\.0$', '') END AS normalized, round(0.5 * 10.0 ** (-len(split_part(p, '.', 2))), 9) AS uncertainty
 FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || '.0' WHEN 1 THEN 'TIC' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS t, o_custkey || '.' || o_orderkey AS p FROM orders)""")
def id_and_rounding(spark, d):
    k = F.col("o_custkey").cast("string")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(k, F.lit(".0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("TIC"), k)).otherwise(k)
    return rounded(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.normalized_id(t).alias("normalized"), S.rounding_uncertainty(F.concat_ws(".", k, F.col("o_orderkey").cast("string"))).alias("uncertainty")), 9)
