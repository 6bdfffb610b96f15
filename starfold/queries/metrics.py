"""Queries on predictions: calibration, scores, abstention, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.operators import classify
from starfold.operators import metrics as M
from starfold.queries import query
from starfold.queries.curves import rounded
from starfold.sources.tables import table

CLASSES = ["clean", "poor", "toxic"]
# Truth is a document's label; the "model" is a fixed rule on its length and key.
PRED_SQL = """p0 AS (SELECT l.doc_id, lang, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' ELSE 'poor' END AS truth, n_chars, 0.2 + (l.doc_id * 37 % 101) / 100.0::DOUBLE AS a, 0.1 + least(n_chars, 4000) / 5000.0::DOUBLE AS b, 0.15 + (l.doc_id * 53 % 97) / 120.0::DOUBLE AS c FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
 p1 AS (SELECT *, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS probabilities FROM p0),
 p2 AS (SELECT *, list_reverse_sort(probabilities) AS o FROM p1),
 pred AS (SELECT doc_id, lang, truth, n_chars, probabilities, o[1] AS confidence, o[1] - o[2] AS margin, ['clean', 'poor', 'toxic'][list_position(probabilities, o[1])] AS prediction FROM p2),
 abst AS (SELECT *, confidence < 0.4 OR margin < 0.1 AS abstained FROM pred)"""


def predictions(spark, d):
    k, n = F.col("doc_id"), F.col("n_chars")
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    truth = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("poor")
    a, b, c = 0.2 + k * 37 % 101 / 100.0, 0.1 + F.least(n, F.lit(4000)) / 5000.0, 0.15 + k * 53 % 97 / 120.0
    rows = x.select("doc_id", "lang", truth.alias("truth"), "n_chars", a.alias("a"), b.alias("b"), c.alias("c"))
    s = F.col("a") + F.col("b") + F.col("c")
    rows = rows.withColumn("probabilities", F.array(F.col("a") / s, F.col("b") / s, F.col("c") / s)).drop("a", "b", "c")
    return M.predicted(rows, CLASSES)


def abstaining(spark, d):
    x = predictions(spark, d)
    said = M.abstain(x, 0.4, 0.1).select("doc_id", "abstained")
    return x.join(said, "doc_id")


@query(f"WITH {PRED_SQL}, b AS (SELECT ceil(confidence * 10) AS bin, count(*) AS n, avg((truth = prediction)::INT) AS acc, avg(confidence) AS conf FROM pred GROUP BY 1) SELECT round(sum(n / (SELECT count(*) FROM pred)::DOUBLE * abs(acc - conf)), 6) AS ece FROM b WHERE bin > 0")
def ece(spark, d):
    return rounded(M.expected_calibration_error(predictions(spark, d)))


@query(f"WITH {PRED_SQL} SELECT round(avg((probabilities[1] - (truth = 'clean')::INT) ** 2 + (probabilities[2] - (truth = 'poor')::INT) ** 2 + (probabilities[3] - (truth = 'toxic')::INT) ** 2), 6) AS brier FROM pred")
def brier(spark, d):
    return rounded(M.brier(predictions(spark, d), CLASSES))


CLASS_SQL = """cls AS (SELECT unnest(['clean', 'poor', 'toxic']) AS class),
 m AS (SELECT class, count(*) FILTER (NOT abstained AND prediction = class AND truth = class) AS tp, count(*) FILTER (NOT abstained AND prediction = class AND truth <> class) AS fp, count(*) FILTER (NOT (NOT abstained AND prediction = class) AND truth = class) AS fn FROM cls, abst GROUP BY 1),
 pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM m),
 f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


@query(f"WITH {PRED_SQL}, {CLASS_SQL} SELECT class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def classification_metrics(spark, d):
    return rounded(M.classification(abstaining(spark, d), CLASSES))


@query(f"WITH {PRED_SQL}, {CLASS_SQL} SELECT round((SELECT avg((NOT abstained AND truth = prediction)::INT) FROM abst), 6) AS accuracy, round((SELECT avg((NOT abstained)::INT) FROM abst), 6) AS coverage, round(avg(f1), 6) AS macro_f1, round(avg(recall), 6) AS balanced_accuracy FROM f")
def holdout_scores(spark, d):
    return rounded(M.scores(abstaining(spark, d), CLASSES))


@query(f"WITH {PRED_SQL} SELECT truth, count(*) FILTER (prediction = 'clean') AS clean, count(*) FILTER (prediction = 'poor') AS poor, count(*) FILTER (prediction = 'toxic') AS toxic FROM pred GROUP BY 1")
def confusion_matrix(spark, d):
    return M.confusion(predictions(spark, d), CLASSES)


@query(f"""WITH {PRED_SQL}, g AS (SELECT c, m, i * 5 + j AS k FROM (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS c, unnest(range(5)) AS i), (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS m, unnest(range(5)) AS j)),
 t AS (SELECT c, m, k, avg((confidence >= c AND margin >= m)::INT) AS cov, coalesce(avg((truth = prediction)::INT) FILTER (confidence >= c AND margin >= m), 0) AS acc FROM g, pred GROUP BY 1, 2, 3), s AS (SELECT *, round(2 * acc * cov / (acc + cov + 1e-6), 12) AS score FROM t WHERE cov >= 0.5),
 z AS (SELECT c, m FROM s ORDER BY score DESC, k LIMIT 1) SELECT coalesce(max(c), 0.5) AS least_confidence, coalesce(max(m), 0.15) AS least_margin FROM z""")
def abstention_tuning(spark, d):
    return M.tune_abstention(predictions(spark, d), 0.5)


@query(f"WITH {PRED_SQL} SELECT doc_id, confidence < 0.5 OR margin < 0.2 OR n_chars > 60000 AS abstained, CASE WHEN NOT (confidence < 0.5 OR margin < 0.2 OR n_chars > 60000) THEN prediction END AS prediction FROM pred")
def abstention_predict(spark, d):
    far = M.outside_bounds({"n": F.col("n_chars").cast("double")}, {"n": (0.0, 10000.0)})
    return M.abstain(predictions(spark, d), 0.5, 0.2, far).select("doc_id", "abstained", "prediction")


@query("SELECT doc_id, n_chars < 500 - 0.5 * 1500 OR n_chars > 2000 + 0.5 * 1500 AS outside FROM documents")
def ood_guard(spark, d):
    far = M.outside_bounds({"n": F.col("n_chars").cast("double")}, {"n": (500.0, 2000.0)}, spans=0.5)
    return table(spark, d, "documents").select("doc_id", far.alias("outside"))


@query("""WITH p AS (SELECT (event_id * 7919 % 10007) / 10007.0::DOUBLE AS p FROM events), r AS (SELECT p, cume_dist() OVER (ORDER BY p) AS cdf FROM p) SELECT count(*) AS n, count(*) FILTER (p <= 0.05) AS alerts, round(greatest(max(cdf - p), 0), 6) AS excess FROM r""")
def ks_excess(spark, d):
    return rounded(M.ks_excess(table(spark, d, "events").select((F.col("event_id") * 7919 % 10007 / 10007.0).alias("p")), "p"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS period, o_orderstatus AS depth, count(*) AS trials, count(*) FILTER (o_totalprice > 200000) AS detected, round(median(o_totalprice), 4) AS error FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey, o_orderstatus), ())")
def injection_summary(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.select(F.col("n_regionkey").cast("bigint").alias("period"), F.col("o_orderstatus").alias("depth"), "o_totalprice")
    return x.groupingSets([[F.col("period"), F.col("depth")], []], F.col("period"), F.col("depth")).agg(F.count("*").alias("trials"), F.count_if(F.col("o_totalprice") > 200000).alias("detected"), F.round(F.median("o_totalprice"), 4).alias("error"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def cohort_audit(spark, d):
    return M.counts_by_sets(table(spark, d, "documents"), ["lang"], ["source"])


@query("SELECT event_type AS product_id, count(*) AS n, count(DISTINCT user_id) AS targets, CAST(min(epoch_us(ts)) AS BIGINT) AS first_us, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us FROM events GROUP BY 1")
def target_set_audit(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("product_id")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("targets"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query("SELECT name AS feature, round(median(x), 6) AS median, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (UNPIVOT (SELECT l_quantity::DOUBLE AS quantity, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem) ON quantity, discount, tax INTO NAME name VALUE x) GROUP BY 1")
def imputation_bounds(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = x.unpivot([], ["quantity", "discount", "tax"], "feature", "x")
    return rounded(long.groupBy("feature").agg(F.median("x").alias("median"), F.min("x").alias("low"), F.max("x").alias("high")))


@query()
def grouped_bootstrap(spark, d):
    """Interval of the accuracy over 500 draws of languages; hashes differ between engines, so it has no SQL."""
    return M.grouped_bootstrap(predictions(spark, d), "lang", 500)


#: Newton steps in the inverse temperature, each over all rows.
TEMPERATURE_SQL = """WITH RECURSIVE x AS (SELECT [l_quantity / 8.0::DOUBLE, l_extendedprice / 12000.0::DOUBLE, l_discount * 60.0::DOUBLE] AS z, CASE WHEN l_orderkey % 5 < 3 THEN CASE WHEN l_quantity / 8 >= l_extendedprice / 12000 AND l_quantity / 8 >= l_discount * 60 THEN 0 WHEN l_extendedprice / 12000 >= l_discount * 60 THEN 1 ELSE 2 END ELSE l_linenumber % 3 END AS y FROM lineitem),
 s AS (SELECT list_max(z) AS top, z[1] - list_max(z) AS a, z[2] - list_max(z) AS b, z[3] - list_max(z) AS c, z[y + 1] - list_max(z) AS own FROM x),
 steps AS (SELECT 0 AS k, 1.0::DOUBLE AS t UNION ALL SELECT k + 1, t - (SELECT avg((a * exp(t * a) + b * exp(t * b) + c * exp(t * c)) / (exp(t * a) + exp(t * b) + exp(t * c)) - own) /
   avg((a * a * exp(t * a) + b * b * exp(t * b) + c * c * exp(t * c)) / (exp(t * a) + exp(t * b) + exp(t * c)) - ((a * exp(t * a) + b * exp(t * b) + c * exp(t * c)) / (exp(t * a) + exp(t * b) + exp(t * c))) ** 2) FROM s) FROM steps WHERE k < 14),
 best AS (SELECT t FROM steps WHERE k = 14)
 SELECT round(1 / t, 6) AS temperature, round((SELECT avg(ln(exp(a) + exp(b) + exp(c)) - own) FROM s), 6) AS loss_before, round((SELECT avg(ln(exp(t * a) + exp(t * b) + exp(t * c)) - t * own) FROM s), 6) AS loss_after FROM best"""


@query(TEMPERATURE_SQL)
def temperature_scaling(spark, d):
    """The temperature of three scores of every line, of which two fifths have another class."""
    a, b, c = F.col("l_quantity") / 8, F.col("l_extendedprice") / 12000, F.col("l_discount") * 60
    most = F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)
    rows = table(spark, d, "lineitem").select(F.array(a, b, c).cast("array<double>").alias("logits"), F.when(F.col("l_orderkey") % 5 < 3, most).otherwise(F.col("l_linenumber") % 3).alias("label"))
    return rounded(spark.createDataFrame([classify.temperature(rows, "logits", "label")], "temperature double, loss_before double, loss_after double"))
