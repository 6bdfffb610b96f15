"""Queries on light curves: flags, segments, scatter, folds, features, detrending, synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators import prepare as P
from starfold.operators import transit as T
from starfold.queries import query
from starfold.sources.tables import EVENTS_SQL, LINEITEM_SQL, events_curve, lineitem_curve


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


# --- flags and segments ------------------------------------------------------------------

MASK = S.QUALITY_MASK
#: Of the quality numbers of long curves, those from 4 to 7 exclude.
LONG_MASK = 4

FLAGS_SQL = """base AS (SELECT *, (CASE WHEN isnan(time_days) OR isnan(flux) THEN 1 ELSE 0 END) + (CASE WHEN flux <= 0 THEN 2 ELSE 0 END)
   + (CASE WHEN (quality & {mask}) <> 0 THEN 8 ELSE 0 END) AS f0 FROM curve),
 med AS (SELECT target_id, count(*) AS n, median(flux) AS m FROM base WHERE f0 = 0 GROUP BY 1),
 sca AS (SELECT b.target_id, any_value(n) AS n, any_value(m) AS m, 1.4826 * median(abs(flux - m)) AS s FROM base b JOIN med USING (target_id) WHERE f0 = 0 GROUP BY 1),
 flagged AS (SELECT b.*, f0 + CASE WHEN f0 = 0 AND n > 10 AND s > 0 AND flux > m + {sigma} * s THEN 16 ELSE 0 END AS exclusion_flags FROM base b LEFT JOIN sca USING (target_id))"""

SEGMENT_SQL = """steps AS (SELECT *, time_days - lag(time_days) OVER (PARTITION BY target_id ORDER BY time_days, cadence) AS dt FROM flagged WHERE exclusion_flags = 0),
 segs AS (SELECT *, CAST(sum(CASE WHEN dt > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY target_id ORDER BY time_days, cadence) AS BIGINT) AS segment_id FROM steps),
 segmed AS (SELECT target_id, segment_id, median(flux) AS sm FROM segs GROUP BY 1, 2),
 prep AS (SELECT s.*, CASE WHEN sm > 0 THEN flux / sm ELSE flux END AS flux_norm FROM segs s JOIN segmed USING (target_id, segment_id))"""


def _prep_sql(curve: str, gap: float, sigma: float = 5.0, mask: int = MASK) -> str:
    return f"WITH {curve},\n {FLAGS_SQL.format(sigma=sigma, mask=mask)},\n {SEGMENT_SQL.format(gap=gap)}"


EVENTS_PREP = _prep_sql(EVENTS_SQL, 0.25)
LINEITEM_PREP = _prep_sql(LINEITEM_SQL, 12.0, 2.0, LONG_MASK)


def events_prep(spark: SparkSession, d: str) -> DataFrame:
    return P.prepared(events_curve(spark, d), 0.25)


def lineitem_prep(spark: SparkSession, d: str) -> DataFrame:
    return P.prepared(lineitem_curve(spark, d), 12.0, sigma=2.0, mask=LONG_MASK)


@query(f"WITH {EVENTS_SQL}, {FLAGS_SQL.format(sigma=1.0, mask=MASK)} SELECT target_id, cadence, CAST(exclusion_flags AS BIGINT) AS exclusion_flags FROM flagged")
def quality_flags(spark, d):
    return rounded(P.quality_flags(events_curve(spark, d), sigma=1.0).select("target_id", "cadence", "exclusion_flags"))


@query(f"WITH {LINEITEM_SQL}, {FLAGS_SQL.format(sigma=1.5, mask=MASK)} SELECT target_id, cadence, flux FROM flagged WHERE exclusion_flags = 16")
def outlier_clip(spark, d):
    return P.quality_flags(lineitem_curve(spark, d), sigma=1.5).filter("exclusion_flags = 16").select("target_id", "cadence", "flux")


@query(f"""WITH {LINEITEM_SQL}, {FLAGS_SQL.format(sigma=1.5, mask=MASK)}, bits AS (SELECT unnest([1, 2, 4, 8, 16]) AS b)
SELECT CAST(b AS BIGINT) AS flag, CAST(sum(CASE WHEN (exclusion_flags & b) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS cadences FROM flagged, bits GROUP BY b""")
def exclusion_histogram(spark, d):
    flagged = P.quality_flags(lineitem_curve(spark, d), sigma=1.5)
    bits = flagged.groupBy("exclusion_flags").count().withColumn("flag", F.explode(F.array(*[F.lit(b) for b in (1, 2, 4, 8, 16)])))
    return rounded(bits.groupBy("flag").agg(F.sum(F.when(F.col("exclusion_flags").bitwiseAND(F.col("flag")) != 0, F.col("count")).otherwise(0)).alias("cadences")))


@query("SELECT o_orderkey AS product_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3054 ELSE 1130799 END AS BIGINT) AS mask FROM orders")
def mission_quality_policy(spark, d):
    mission = F.when(F.col("o_orderkey") % 2 == 0, "TESS").otherwise("Kepler")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("product_id"), P.mission_mask(mission).cast("bigint").alias("mask"))


@query(EVENTS_PREP + " SELECT target_id, segment_id, count(*) AS n, round(min(time_days), 6) AS first_days, round(max(time_days), 6) AS last_days FROM prep GROUP BY 1, 2")
def gap_segments(spark, d):
    return rounded(events_prep(spark, d).groupBy("target_id", "segment_id").agg(F.count("*").alias("n"), F.min("time_days").alias("first_days"), F.max("time_days").alias("last_days")))


@query(EVENTS_PREP + " SELECT target_id, cadence, segment_id, round(flux_norm, 6) AS flux_norm FROM prep")
def segment_normalize(spark, d):
    return rounded(events_prep(spark, d).select("target_id", "cadence", "segment_id", "flux_norm"))


SCATTER_SQL = """diffs AS (SELECT target_id, flux_norm - lag(flux_norm) OVER (PARTITION BY target_id, segment_id ORDER BY time_days, cadence) AS step FROM prep),
 dmed AS (SELECT target_id, median(step) AS m FROM diffs GROUP BY 1),
 ptp AS (SELECT d.target_id, coalesce(1.4826 * median(abs(step - m)) / sqrt(2) * 1e6, 0) AS scatter_ptp_ppm FROM diffs d JOIN dmed USING (target_id) GROUP BY 1)"""


def cdpp_sql(hours: float, tag: str) -> str:
    return f"""dt{tag} AS (SELECT target_id, median(dt) AS dt FROM (SELECT target_id, time_days - lag(time_days) OVER (PARTITION BY target_id ORDER BY time_days, cadence) AS dt FROM prep) GROUP BY 1),
 size{tag} AS (SELECT target_id, CAST(greatest(1, coalesce(round_even({hours}::DOUBLE / 24 / CASE WHEN dt > 0 THEN dt END, 0), 1)) AS BIGINT) AS block FROM dt{tag}),
 rows{tag} AS (SELECT p.*, row_number() OVER (PARTITION BY target_id, segment_id ORDER BY time_days, cadence) - 1 AS rn FROM prep p),
 means{tag} AS (SELECT r.target_id, segment_id, rn // block AS b, any_value(block) AS block, avg(flux_norm) AS mean, count(*) AS n FROM rows{tag} r JOIN size{tag} USING (target_id) GROUP BY 1, 2, 3),
 whole{tag} AS (SELECT * FROM means{tag} WHERE n = block), mm{tag} AS (SELECT target_id, median(mean) AS m, count(*) AS blocks FROM whole{tag} GROUP BY 1),
 mad{tag} AS (SELECT w.target_id, any_value(blocks) AS blocks, 1.4826 * median(abs(mean - m)) AS mad FROM whole{tag} w JOIN mm{tag} USING (target_id) GROUP BY 1),
 cdpp{tag} AS (SELECT s.target_id, CASE WHEN blocks >= 3 THEN mad * 1e6 ELSE scatter_ptp_ppm / sqrt(block) END AS cdpp_{tag}h FROM size{tag} s LEFT JOIN mad{tag} USING (target_id) JOIN ptp USING (target_id))"""


@query(f"{EVENTS_PREP}, {SCATTER_SQL} SELECT target_id, round(scatter_ptp_ppm, 4) AS scatter_ptp_ppm FROM ptp")
def ptp_scatter(spark, d):
    return rounded(P.ptp_scatter(events_prep(spark, d)), 4)


@query(f"{LINEITEM_PREP}, {SCATTER_SQL}, {cdpp_sql(240, '240')} SELECT target_id, round(cdpp_240h, 4) AS cdpp_240h FROM cdpp240")
def cdpp_proxy(spark, d):
    return rounded(P.cdpp(lineitem_prep(spark, d), 240, "cdpp_240h"), 4)


@query(f"""{EVENTS_PREP}, {SCATTER_SQL}, {cdpp_sql(1, '1')}, {cdpp_sql(2, '2')}, {cdpp_sql(6, '6')},
 counts AS (SELECT target_id, count(*) AS initial, count(*) FILTER (exclusion_flags = 0) AS valid, count(*) FILTER (exclusion_flags <> 0) AS excluded FROM flagged GROUP BY 1),
 segn AS (SELECT target_id, count(DISTINCT segment_id) AS segment_count FROM prep GROUP BY 1)
 SELECT target_id, initial, valid, excluded, segment_count, round(scatter_ptp_ppm, 4) AS scatter_ptp_ppm, round(cdpp_1h, 4) AS cdpp_1h, round(cdpp_2h, 4) AS cdpp_2h, round(cdpp_6h, 4) AS cdpp_6h
 FROM counts JOIN segn USING (target_id) JOIN ptp USING (target_id) JOIN cdpp1 USING (target_id) JOIN cdpp2 USING (target_id) JOIN cdpp6 USING (target_id)""")
def prepare_summary(spark, d):
    """The flagship: prepared curves, one row a target."""
    return rounded(P.summary(events_curve(spark, d)), 4)


@query(f"""WITH {EVENTS_SQL}, {FLAGS_SQL.format(sigma=5.0, mask=MASK)} SELECT target_id, CASE WHEN count(*) FILTER (exclusion_flags = 0) < 60 OR max(time_days) - min(time_days) < 2 THEN 'insufficient_data' ELSE 'ok' END AS status FROM flagged GROUP BY 1""")
def minimum_data_guard(spark, d):
    f = P.quality_flags(events_curve(spark, d))
    short = (F.count_if(F.col("exclusion_flags") == 0) < 60) | (F.max("time_days") - F.min("time_days") < 2)
    return f.groupBy("target_id").agg(F.when(short, "insufficient_data").otherwise("ok").alias("status"))


# --- folds ------------------------------------------------------------------------------

CANDIDATES_SQL = """cand AS (SELECT s_suppkey AS target_id, 3.2137713::DOUBLE + s_suppkey % 5 AS epoch, 20.137::DOUBLE + s_suppkey % 37 AS period, 4.33::DOUBLE + (s_suppkey % 3) AS duration, 0.05::DOUBLE AS depth,
 0.1 + (s_suppkey % 8) * 0.1 AS ingress, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 30 - 12.5 END AS delta_bic, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 50 + 0.5 END AS snr,
 CASE WHEN s_suppkey % 7 > 0 THEN 0.7 + (s_suppkey % 31) * 0.01 END AS crowding, 10.5 + s_suppkey % 41 AS ls_period, (s_suppkey % 100) / 100.0 AS ls_power FROM supplier)"""


def supplier_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    some = lambda n, x: F.when(k % n > 0, x)
    return s.select(
        k.alias("target_id"),
        (3.2137713 + k % 5).alias("epoch"),
        (20.137 + k % 37).alias("period"),
        (4.33 + k % 3).alias("duration"),
        F.lit(0.05).alias("depth"),
        (0.1 + k % 8 * 0.1).alias("ingress"),
        some(4, k % 30 - 12.5).alias("delta_bic"),
        some(6, k % 50 + 0.5).alias("snr"),
        some(7, 0.7 + k % 31 * 0.01).alias("crowding"),
        (10.5 + k % 41).alias("ls_period"),
        (k % 100 / 100.0).alias("ls_power"),
    )


FOLD_SQL = f"""{LINEITEM_PREP}, {CANDIDATES_SQL},
 f1 AS (SELECT p.*, flux / 60000.0 AS flux_delivered, c.* EXCLUDE (target_id), time_days - epoch + period / 2.0 AS sh FROM prep p JOIN cand c USING (target_id)),
 f2 AS (SELECT *, sh - period * floor(sh / period) - period / 2.0 AS phase, CAST(round_even((time_days - epoch) / period, 0) AS BIGINT) AS cycle, 0.5 * duration / period AS half FROM f1),
 f3 AS (SELECT *, phase / period AS fraction FROM f2),
 fold AS (SELECT *, abs(fraction) <= half AS inside, abs(fraction) > 1.2 * half AS outside FROM f3)"""


def lineitem_fold(spark: SparkSession, d: str) -> DataFrame:
    prep = lineitem_prep(spark, d).withColumn("flux_delivered", F.col("flux") / 60000.0)
    return T.folded(prep, supplier_candidates(spark, d))


@query(FOLD_SQL + " SELECT target_id, cadence, round(phase, 6) AS phase, round(fraction, 6) AS fraction FROM fold")
def phase_fold(spark, d):
    return rounded(lineitem_fold(spark, d).select("target_id", "cadence", "phase", "fraction"))


@query(FOLD_SQL + " SELECT target_id, cycle, count(*) AS n, count(*) FILTER (inside) AS n_inside FROM fold GROUP BY 1, 2")
def cycle_index(spark, d):
    return lineitem_fold(spark, d).groupBy("target_id", "cycle").agg(F.count("*").alias("n"), F.count_if("inside").alias("n_inside"))


@query(f"WITH {LINEITEM_SQL}, {CANDIDATES_SQL}, m AS (SELECT curve.target_id, cadence, time_days - epoch + period / 2.0 AS sh, period, duration FROM curve JOIN cand USING (target_id)) SELECT target_id, count(*) AS n, count(*) FILTER (abs(sh - period * floor(sh / period) - period / 2.0) <= 0.75 * duration) AS masked FROM m GROUP BY 1")
def in_transit_mask(spark, d):
    m = T.transit_mask(lineitem_curve(spark, d), supplier_candidates(spark, d))
    return m.groupBy("target_id").agg(F.count("*").alias("n"), F.count_if("masked").alias("masked"))


@query(FOLD_SQL + ", h AS (SELECT *, greatest(2.0 / 24, 3.5 * duration) AS w FROM fold), b AS (SELECT *, CAST(floor((phase + w) / (2 * w) * 30) AS BIGINT) AS bin FROM h) SELECT target_id, bin, round(median(flux_norm), 6) AS flux, count(*) AS n FROM b WHERE bin >= 0 AND bin < 30 GROUP BY 1, 2")
def fold_binned_median(spark, d):
    return rounded(T.binned_median(lineitem_fold(spark, d), 30))


@query(FOLD_SQL + ", h AS (SELECT *, greatest(2.0 / 24, 3.5 * duration) AS w FROM fold), b AS (SELECT *, CAST(floor((phase + w) / (2 * w) * 35) AS BIGINT) AS bin FROM h) SELECT target_id, bin, round(median(flux_norm), 6) AS flux, count(*) AS n FROM b WHERE bin >= 0 AND bin < 35 GROUP BY 1, 2")
def fold_binned_median_viewer(spark, d):
    return rounded(T.binned_median(lineitem_fold(spark, d), 35))


# --- measurements and features: each SQL is a CTE f_<name> over fold ----------------------

DEPTHS_SQL = "depths AS (SELECT target_id, cycle, count(*) AS n, 1 - median(flux_norm) AS event_depth FROM fold WHERE inside GROUP BY 1, 2 HAVING count(*) >= 3)"

PARTS = {
    "morphology": """f_morphology AS (SELECT target_id, max(ingress) AS v_shape_ratio, max(duration) / max(period) AS duration_to_period_ratio, 1 - max(ingress) AS boxiness_index,
  CASE WHEN count(*) FILTER (inside AND fraction < 0) >= 2 AND count(*) FILTER (inside AND fraction >= 0) >= 2 THEN abs(avg(flux_norm) FILTER (inside AND fraction < 0) - avg(flux_norm) FILTER (inside AND fraction >= 0)) / greatest(max(depth), 1e-5) ELSE 0 END AS asymmetry_score,
  coalesce(max(delta_bic), 0) AS batman_vs_trapezoid_delta_bic FROM fold GROUP BY 1)""",
    "odd_even": """oe AS (SELECT target_id, avg(flux_norm) FILTER (cycle % 2 <> 0) AS a, avg(flux_norm) FILTER (cycle % 2 = 0) AS b, count(*) FILTER (cycle % 2 <> 0) AS n, count(*) FILTER (cycle % 2 = 0) AS m,
   var_pop(flux_norm) FILTER (cycle % 2 <> 0) AS va, var_pop(flux_norm) FILTER (cycle % 2 = 0) AS vb FROM fold WHERE inside GROUP BY 1),
 f_odd_even AS (SELECT t.target_id, CASE WHEN n >= 3 AND m >= 3 THEN abs(a - b) / sqrt(greatest(1e-12, va / n + vb / m)) ELSE 0 END AS odd_even_depth_sigma FROM (SELECT DISTINCT target_id FROM fold) t LEFT JOIN oe USING (target_id))""",
    "depth_scatter": """dm AS (SELECT target_id, median(event_depth) AS m FROM depths GROUP BY 1),
 f_depth_scatter AS (SELECT d.target_id, CAST(count(*) AS DOUBLE) AS observed_event_count, CASE WHEN count(*) >= 2 THEN 1.4826 * median(abs(event_depth - m)) / greatest(1e-5, any_value(m)) ELSE 0.1 END AS per_transit_depth_mad_ratio FROM depths d JOIN dm USING (target_id) GROUP BY 1)""",
    "phase_coverage": "f_phase_coverage AS (SELECT target_id, count(DISTINCT CASE WHEN abs(phase / (duration / 2.0)) <= 1 THEN least(floor((phase / (duration / 2.0) + 1) / 2 * 20), 19) END) / 20.0 AS phase_coverage_fraction FROM fold GROUP BY 1)",
    "duty_cycle": """ex AS (SELECT target_id, CAST(greatest(1, floor((max(time_days) - max(epoch)) / max(period)) - ceil((min(time_days) - max(epoch)) / max(period)) + 1) AS BIGINT) AS expected FROM fold GROUP BY 1),
 f_duty_cycle AS (SELECT ex.target_id, coalesce(observed, 0) AS observed, expected, least(coalesce(observed, 0)::DOUBLE / expected, 1.0) AS in_transit_duty_cycle FROM ex LEFT JOIN (SELECT target_id, count(*) AS observed FROM depths GROUP BY 1) USING (target_id))""",
    "secondary_scan": """om AS (SELECT target_id, median(flux_norm) AS m FROM fold WHERE outside GROUP BY 1),
 sc AS (SELECT f.target_id, greatest(1e-6, CASE WHEN count(*) > 10 THEN 1.4826 * median(abs(flux_norm - m)) ELSE 1e-3 END) AS scatter FROM fold f JOIN om USING (target_id) WHERE outside GROUP BY 1),
 far AS (SELECT * FROM fold WHERE outside AND abs(fraction) >= 0.35), ks AS (SELECT unnest(range(9)) AS k),
 dips AS (SELECT target_id, k, 1 - avg(flux_norm) AS dip, count(*) AS n FROM far, ks WHERE abs(abs(fraction) - (0.35 + k * (0.15 / 8))) <= half GROUP BY 1, 2 HAVING count(*) >= 3),
 snrs AS (SELECT d.*, round(dip / (scatter / sqrt(n)), 9) AS snr FROM dips d JOIN sc USING (target_id)),
 best AS (SELECT target_id, arg_max({'snr': snr, 'dip': dip, 'k': k}, [snr, -k]) AS b FROM snrs WHERE snr > 0 GROUP BY 1),
 f_secondary_scan AS (SELECT a.target_id, CASE WHEN n >= 5 AND b IS NOT NULL THEN b.snr ELSE 0 END AS max_secondary_snr, CASE WHEN n >= 5 AND b IS NOT NULL THEN greatest(b.dip, 0) / depth ELSE 0 END AS secondary_to_primary_depth_ratio,
  CASE WHEN n >= 5 AND b IS NOT NULL THEN 0.15 - b.k * (0.15 / 8) ELSE 0 END AS secondary_phase_offset_from_half
  FROM (SELECT target_id, greatest(max(depth), 1e-5) AS depth, count(*) FILTER (outside AND abs(fraction) >= 0.35) AS n FROM fold GROUP BY 1) a LEFT JOIN best USING (target_id))""",
    "ellipsoidal": """oavg AS (SELECT target_id, avg(flux_norm) AS m FROM fold WHERE outside GROUP BY 1),
 f_ellipsoidal AS (SELECT f.target_id, CASE WHEN count(*) >= 20 AND sum(cos(4 * pi() * fraction) ** 2) > 1e-6 THEN greatest(-sum((flux_norm - m) * cos(4 * pi() * fraction)) / sum(cos(4 * pi() * fraction) ** 2), 0) / greatest(max(depth), 1e-5) ELSE 0 END AS ellipsoidal_amplitude_ratio FROM fold f JOIN oavg USING (target_id) WHERE outside GROUP BY 1)""",
    "candidate_columns": "f_candidate_columns AS (SELECT target_id, max(ls_power) AS ls_max_power, least(abs(0.33333 * max(ls_period) / max(period) - 1), abs(0.5 * max(ls_period) / max(period) - 1), abs(max(ls_period) / max(period) - 1), abs(2 * max(ls_period) / max(period) - 1), abs(3 * max(ls_period) / max(period) - 1)) AS ls_to_bls_period_harmonic_distance, max(snr) AS detection_snr, max(crowding) AS crowdsap_value FROM fold GROUP BY 1)",
    "outside_rms": "f_outside_rms AS (SELECT target_id, CASE WHEN count(*) FILTER (outside) >= 10 THEN stddev_pop(flux_norm) FILTER (outside) / greatest(max(depth), 1e-5) ELSE 1 END AS out_of_transit_rms_to_depth_ratio FROM fold GROUP BY 1)",
    "lag_autocorrelation": """ut AS (SELECT target_id, time_days AS t, arg_min(flux_norm, cadence) AS x2 FROM fold GROUP BY 1, 2),
 pr AS (SELECT f.target_id, f.time_days + f.period AS due, flux_norm AS x, duration, u.t, u.x2 FROM fold f ASOF JOIN ut u ON f.target_id = u.target_id AND f.time_days + f.period <= u.t),
 pc AS (SELECT target_id, count(*) AS pairs, avg((x - 1) * (x2 - 1)) AS cov FROM pr WHERE abs(t - due) <= greatest(0.01, 0.2 * duration) GROUP BY 1),
 f_lag_autocorrelation AS (SELECT b.target_id, coalesce(pairs, 0) AS pairs, coalesce(CASE WHEN n >= 50 AND pairs >= 10 AND v > 1e-12 THEN least(greatest(cov / v, -1), 1) END, 0) AS autocorrelation_at_period FROM (SELECT target_id, count(*) AS n, var_pop(flux_norm) AS v FROM fold GROUP BY 1) b LEFT JOIN pc USING (target_id))""",
    "red_noise_beta": """rdt AS (SELECT target_id, median(dt) AS dt FROM (SELECT target_id, time_days - lag(time_days) OVER (PARTITION BY target_id ORDER BY time_days, cadence) AS dt FROM fold) WHERE dt > 0 GROUP BY 1),
 rmed AS (SELECT target_id, median(flux_norm) AS m FROM fold GROUP BY 1),
 rw AS (SELECT f.target_id, max(duration) AS duration, greatest(1e-6, 1.4826 * median(abs(flux_norm - m))) AS white FROM fold f JOIN rmed USING (target_id) GROUP BY 1),
 rs AS (SELECT rw.target_id, white, CAST(greatest(1, round_even(greatest(1.0, duration / greatest(1e-5, coalesce(dt, 2.0 / 1440))), 0)) AS BIGINT) AS size FROM rw LEFT JOIN rdt USING (target_id)),
 ro AS (SELECT target_id, flux_norm, row_number() OVER (PARTITION BY target_id ORDER BY time_days, cadence) - 1 AS r FROM fold WHERE NOT inside),
 rb AS (SELECT ro.target_id, size, white, r // size AS b, avg(flux_norm) AS m, count(*) AS n FROM ro JOIN rs USING (target_id) GROUP BY 1, 2, 3, 4 HAVING count(*) = size),
 f_red_noise_beta AS (SELECT target_id, CASE WHEN count(*) >= 5 THEN stddev_pop(m) / greatest(1e-6, max(white) / sqrt(max(size))) ELSE 1 END AS red_noise_beta_factor FROM rb GROUP BY 1)""",
    "flagged_fraction": "f_flagged_fraction AS (SELECT target_id, coalesce(count(*) FILTER (inside AND quality <> 0) / nullif(count(*) FILTER (inside), 0)::DOUBLE, 0) AS in_transit_flagged_fraction FROM fold GROUP BY 1)",
    "gap_proximity": """sb AS (SELECT target_id, segment_id, min(time_days) AS lo, max(time_days) AS hi FROM fold GROUP BY 1, 2),
 f_gap_proximity AS (SELECT f.target_id, coalesce(count(*) FILTER (inside AND least(time_days - lo, hi - time_days) <= 1.0 / 24) / nullif(count(*) FILTER (inside), 0)::DOUBLE, 0) AS gap_proximity_fraction FROM fold f JOIN sb USING (target_id, segment_id) GROUP BY 1)""",
    "centroid_shift": """cs AS (SELECT target_id, count(*) FILTER (inside) AS ni, count(*) FILTER (NOT inside) AS no, avg(centroid_column) FILTER (inside) - avg(centroid_column) FILTER (NOT inside) AS dx, avg(centroid_row) FILTER (inside) - avg(centroid_row) FILTER (NOT inside) AS dy,
   (var_pop(centroid_column) FILTER (inside) + var_pop(centroid_row) FILTER (inside)) / nullif(count(*) FILTER (inside), 0) + (var_pop(centroid_column) FILTER (NOT inside) + var_pop(centroid_row) FILTER (NOT inside)) / nullif(count(*) FILTER (NOT inside), 0) AS e FROM fold GROUP BY 1),
 f_centroid_shift AS (SELECT target_id, CASE WHEN ni >= 3 AND no >= 10 THEN sqrt(dx * dx + dy * dy) END AS shift_pixels, CASE WHEN ni >= 3 AND no >= 10 THEN sqrt(dx * dx + dy * dy) / sqrt(greatest(1e-12, e)) END AS centroid_shift_sigma FROM cs)""",
    "delivered_depth_ratio": "f_delivered_depth_ratio AS (SELECT target_id, CASE WHEN count(*) FILTER (inside) >= 3 THEN greatest(0, 1 - median(flux_delivered) FILTER (inside)) / greatest(1e-5, 1 - median(flux_norm) FILTER (inside)) ELSE 1 END AS sap_to_pdcsap_depth_ratio FROM fold GROUP BY 1)",
}

SHOWN = {
    "morphology": ["v_shape_ratio", "duration_to_period_ratio", "boxiness_index", "asymmetry_score", "batman_vs_trapezoid_delta_bic"],
    "odd_even": ["odd_even_depth_sigma"],
    "depth_scatter": ["observed_event_count", "per_transit_depth_mad_ratio"],
    "phase_coverage": ["phase_coverage_fraction"],
    "duty_cycle": ["in_transit_duty_cycle"],
    "secondary_scan": ["max_secondary_snr", "secondary_to_primary_depth_ratio", "secondary_phase_offset_from_half"],
    "ellipsoidal": ["ellipsoidal_amplitude_ratio"],
    "candidate_columns": ["ls_max_power", "ls_to_bls_period_harmonic_distance", "detection_snr", "crowdsap_value"],
    "outside_rms": ["out_of_transit_rms_to_depth_ratio"],
    "lag_autocorrelation": ["pairs", "autocorrelation_at_period"],
    "red_noise_beta": ["red_noise_beta_factor"],
    "flagged_fraction": ["in_transit_flagged_fraction"],
    "gap_proximity": ["gap_proximity_fraction"],
    "centroid_shift": ["shift_pixels", "centroid_shift_sigma"],
    "delivered_depth_ratio": ["sap_to_pdcsap_depth_ratio"],
}


def _register(name: str, columns: list[str]) -> None:
    shown = ", ".join(c if c == "pairs" else f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)

    def run(spark, d):
        return rounded(getattr(T, name)(lineitem_fold(spark, d)).select("target_id", *columns))

    run.__name__ = name
    query(f"{FOLD_SQL}, {DEPTHS_SQL}, {PARTS[name]} SELECT target_id, {shown} FROM f_{name}")(run)


for _name, _columns in SHOWN.items():
    _register(_name, _columns)


@query(FOLD_SQL + f", {DEPTHS_SQL} SELECT target_id, cycle, n, round(event_depth, 6) AS event_depth FROM depths")
def per_event_depths(spark, d):
    return rounded(T.event_depths(lineitem_fold(spark, d)))


@query(FOLD_SQL + """, rn AS (SELECT target_id, flux_norm, (row_number() OVER (PARTITION BY target_id ORDER BY time_days, cadence) - 1) // 8 AS b FROM fold WHERE outside),
 wh AS (SELECT target_id, stddev_pop(flux_norm) AS white FROM rn GROUP BY 1), mb AS (SELECT target_id, b, avg(flux_norm) AS m FROM rn GROUP BY 1, 2 HAVING count(*) = 8), sg AS (SELECT target_id, stddev_pop(m) AS sigma FROM mb GROUP BY 1),
 ins AS (SELECT target_id, count(*) FILTER (inside) AS points, count(DISTINCT CASE WHEN inside THEN cycle END) AS events, max(depth) AS depth FROM fold GROUP BY 1)
 SELECT target_id, round(depth / sqrt(white * white / points + greatest(sigma * sigma - white * white / 8, 0) / events), 6) AS red_noise_snr FROM wh JOIN sg USING (target_id) JOIN ins USING (target_id)""")
def red_noise_snr(spark, d):
    return rounded(T.red_noise_snr(lineitem_fold(spark, d), 8))


@query(FOLD_SQL + f""", {PARTS['centroid_shift']}, cr AS (SELECT target_id, max(crowding) AS crowding FROM fold GROUP BY 1)
 SELECT target_id, CASE WHEN centroid_shift_sigma > 3.5 AND shift_pixels > 0.2 THEN 'off_target' WHEN shift_pixels IS NULL OR crowding IS NULL OR crowding < 0.85 THEN 'unresolved' ELSE 'on_target' END AS assessment,
 round(shift_pixels, 6) AS shift_pixels, round(centroid_shift_sigma, 6) AS centroid_shift_sigma FROM f_centroid_shift JOIN cr USING (target_id)""")
def vet_tier1(spark, d):
    return rounded(T.vet_tier1(lineitem_fold(spark, d)))


@query(FOLD_SQL + ", " + DEPTHS_SQL + ", " + ",\n ".join(PARTS.values()) + " SELECT f_morphology.target_id, " + ", ".join(f"round(CASE WHEN {n} IS NULL OR isnan(CAST({n} AS DOUBLE)) OR isinf(CAST({n} AS DOUBLE)) THEN {default} ELSE least(greatest(CAST({n} AS DOUBLE), {low}), {high}) END, 5) AS {n}" for n, default, low, high in T.FEATURES) + " FROM f_morphology " + " ".join(f"LEFT JOIN f_{p} USING (target_id)" for p in list(PARTS)[1:]))
def feature_vector(spark, d):
    return rounded(T.feature_vector(lineitem_fold(spark, d)), 5)


@query(f"""SELECT l_orderkey AS a, CAST(l_linenumber AS BIGINT) AS b, round(CASE WHEN l_discount = 0 THEN 0.5 ELSE least(greatest(ln(l_discount) / 2, -1), 1) END, 6) AS clipped FROM lineitem""")
def feature_sanitize(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    log = F.when(F.col("l_discount") == 0, F.lit(float("-inf"))).otherwise(F.ln(F.greatest("l_discount", F.lit(1e-300))) / 2)
    return rounded(x.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), S.sanitized(log, 0.5, -1, 1).alias("clipped")))


# --- synthesis --------------------------------------------------------------------------

TRAP_SQL = "1 - {depth} * least(greatest(({dur} / 2 - abs({phase})) / greatest({dur} / 2 * {ing}, 1e-9), 0), 1)"


def _phase_sql(epoch: str, period: str) -> str:
    s = f"(time_days - ({epoch}) + {period} / 2.0)"
    return f"({s} - {period} * floor({s} / {period}) - {period} / 2.0)"


@query(f"WITH {EVENTS_SQL} SELECT target_id, cadence, round({TRAP_SQL.format(depth=0.01, dur=0.4, ing=0.3, phase=_phase_sql('1.3', '3.7'))}, 9) AS model FROM curve")
def trapezoid_flux(spark, d):
    return rounded(events_curve(spark, d).select("target_id", "cadence", S.trapezoid(S.phase_days(F.col("time_days"), 1.3, 3.7), 0.01, 0.4, 0.3).alias("model")), 9)


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT target_id, cadence, (i + 0.5) / 1000.0 * 0.02 - 0.01 AS o, time_days FROM curve, range(1000) r(i)),
 q AS (SELECT target_id, cadence, time_days + o - 1.3 + 3.7 / 2.0 AS s FROM p), h AS (SELECT target_id, cadence, s - 3.7 * floor(s / 3.7) - 3.7 / 2.0 AS ph FROM q)
 SELECT target_id, cadence, round(avg({TRAP_SQL.format(depth=0.01, dur=0.4, ing=0.3, phase='ph')}), 4) AS model FROM h GROUP BY 1, 2""")
def trapezoid_exposure_flux(spark, d):
    """The closed form against 1000 instants of each exposure."""
    return rounded(events_curve(spark, d).select("target_id", "cadence", S.trapezoid_exposed(F.col("time_days"), 1.3, 3.7, 0.01, 0.4, 0.3, 0.02).alias("model")), 4)


@query(f"WITH {EVENTS_SQL} SELECT target_id, cadence, round({TRAP_SQL.format(depth=0.02, dur=0.5, ing=0.9, phase=_phase_sql('1.3', '3.7'))} + {TRAP_SQL.format(depth=0.01, dur=0.5, ing=0.9, phase=_phase_sql('1.3 + 0.5 * 3.7', '3.7'))} - 1 - 0.001 * cos(4 * pi() * (time_days - 1.3) / 3.7), 9) AS model FROM curve")
def eclipsing_binary_flux(spark, d):
    return rounded(events_curve(spark, d).select("target_id", "cadence", S.eclipsing_flux(F.col("time_days"), 1.3, 3.7, 0.5, 0.02, ellipsoidal=0.001).alias("model")), 9)


@query(f"WITH {EVENTS_SQL} SELECT target_id, cadence, round(1 + 0.01 * (sin(2 * pi() * time_days / 2.5) + 0.3 * sin(2 * (2 * pi() * time_days / 2.5))), 9) AS model FROM curve")
def variability_flux(spark, d):
    return rounded(events_curve(spark, d).select("target_id", "cadence", S.variable_flux(F.col("time_days"), 2.5, 0.01, 0.3).alias("model")), 9)


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT *, CAST('0x' || substr(sha256('injection:' || target_id), 1, 8) AS BIGINT) AS seed FROM curve), e AS (SELECT *, (seed % 1000) / 500.0 AS epoch FROM s)
 SELECT target_id, cadence, seed, round(flux * ({TRAP_SQL.format(depth=0.05, dur=0.4, ing=0.3, phase=_phase_sql('epoch', '3.7'))}), 6) AS flux FROM e""")
def inject_signal(spark, d):
    c = events_curve(spark, d).withColumn("seed", S.hash_number(F.concat(F.lit("injection:"), F.col("target_id").cast("string"))))
    model = S.trapezoid(S.phase_days(F.col("time_days"), F.col("seed") % 1000 / 500.0, 3.7), 0.05, 0.4, 0.3)
    return rounded(c.select("target_id", "cadence", "seed", (F.col("flux") * model).alias("flux")))


@query("""SELECT s_suppkey AS id, round(least(abs(p - q) / p, abs(p - 2 * q) / p, abs(p - 0.5 * q) / p, abs(p - 3 * q) / p, abs(p - q / 3) / p, abs(p - 4 * q) / p, abs(p - 0.25 * q) / p), 6) AS distance
 FROM (SELECT s_suppkey, 1.0 + s_suppkey % 17 AS p, 1.5 + s_suppkey % 11 AS q FROM supplier)""")
def harmonic_distance(spark, d):
    k = F.col("s_suppkey")
    return rounded(spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), S.harmonic_distance(1.0 + k % 17, 1.5 + k % 11).alias("distance")))


@query("""SELECT c_custkey AS id, round(CASE WHEN x > 0 AND x <= 1 THEN 0.01 / x END, 6) AS depth, CASE WHEN t IS NULL OR t <= 0 THEN 0.30::DOUBLE WHEN t < 3800 THEN 0.48 WHEN t < 4500 THEN 0.40 WHEN t < 6000 THEN 0.32 WHEN t < 7500 THEN 0.25 ELSE 0.18 END AS u1,
 CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) AS seed FROM (SELECT *, c_acctbal / 8000 AS x, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS t FROM customer)""")
def stellar_parameters(spark, d):
    """Dilution, temperature, limb darkening and stable seeds."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    t = S.effective_temperature(F.col("c_acctbal").cast("string"))
    return rounded(c.select(F.col("c_custkey").alias("id"), S.undiluted_depth(F.lit(0.01), F.col("c_acctbal") / 8000).alias("depth"), S.limb_darkening(t)["u1"].alias("u1"), S.hash_number(F.col("c_name")).alias("seed")))


