"""Queries on detrending, period search, fits, pixels, combination, downsampling and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.functions import tables
from starfold.operators import injection as J
from starfold.operators import kernels as K
from starfold.operators import prepare as P
from starfold.operators import search as X
from starfold.queries import SQL, query
from starfold.queries.curves import EVENTS_PREP, EVENTS_SQL, FOLD_SQL, LINEITEM_PREP, LINEITEM_SQL, lineitem_fold, rounded, supplier_candidates
from starfold.sources.tables import events_curve, lineitem_curve, table
from starfold.streaming import sessions as stream

WIDE_PREP = EVENTS_PREP.replace("> 0.25", "> 2.0")


def wide_prep(spark, d):
    return P.prepared(events_curve(spark, d), 2.0)


@query(f"""{WIDE_PREP}, near AS (SELECT a.target_id, a.cadence, a.flux_norm AS x, b.flux_norm AS y FROM prep a JOIN prep b ON a.target_id = b.target_id AND a.segment_id = b.segment_id AND b.time_days BETWEEN a.time_days - 1.5 AND a.time_days + 1.5),
 m AS (SELECT target_id, cadence, median(y) AS m FROM near GROUP BY 1, 2), s AS (SELECT n.target_id, n.cadence, any_value(m) AS m, any_value(x) AS x, median(abs(y - m)) AS s FROM near n JOIN m USING (target_id, cadence) GROUP BY 1, 2),
 w AS (SELECT n.target_id, n.cadence, s.x, s.m, s.s, y, CASE WHEN s < 1e-12 THEN 0 WHEN abs((y - m) / (6 * s)) < 1 THEN (1 - ((y - m) / (6 * s)) ** 2) ** 2 ELSE 0 END AS w FROM near n JOIN s USING (target_id, cadence)),
 t AS (SELECT target_id, cadence, any_value(x) AS x, CASE WHEN any_value(s) < 1e-12 OR sum(w) = 0 THEN any_value(m) ELSE sum(w * y) / sum(w) END AS trend FROM w GROUP BY 1, 2)
 SELECT target_id, cadence, round(CASE WHEN trend > 0 THEN trend ELSE 1 END, 6) AS trend, round(x / CASE WHEN trend > 0 THEN trend ELSE 1 END, 6) AS flux_detrended FROM t""")
def biweight_trend(spark, d):
    return rounded(X.detrended(wide_prep(spark, d), 3.0).select("target_id", "cadence", "trend", "flux_detrended"))


@query(f"""{WIDE_PREP}, c AS (SELECT DISTINCT c_custkey AS target_id, greatest(3 * 0.3::DOUBLE, 0.5) AS w FROM customer),
 x AS (SELECT p.*, flux_norm AS f, coalesce(w, 3.0) / 2 AS h, w IS NOT NULL AND abs((time_days - 1.3 + 2.35) - 4.7::DOUBLE * floor((time_days - 1.3 + 2.35) / 4.7::DOUBLE) - 2.35) <= 0.225 AS hid FROM prep p LEFT JOIN c USING (target_id)),
 s AS (SELECT target_id, segment_id, count(*) AS n, count(*) FILTER (NOT hid) AS used, min(time_days) AS t0, max(time_days) AS t1, median(f) AS mid FROM x GROUP BY 1, 2),
 near AS (SELECT a.target_id, a.cadence, b.f AS y FROM x a JOIN x b ON a.target_id = b.target_id AND a.segment_id = b.segment_id AND NOT b.hid AND b.time_days BETWEEN a.time_days - a.h AND a.time_days + a.h),
 m AS (SELECT target_id, cadence, median(y) AS m FROM near GROUP BY 1, 2), d AS (SELECT target_id, cadence, any_value(m) AS m, median(abs(y - m)) AS s FROM near JOIN m USING (target_id, cadence) GROUP BY 1, 2),
 w AS (SELECT target_id, cadence, d.m, d.s, y, CASE WHEN s < 1e-12 THEN 0 WHEN abs((y - m) / (6 * s)) < 1 THEN (1 - ((y - m) / (6 * s)) ** 2) ** 2 ELSE 0 END AS w FROM near JOIN d USING (target_id, cadence)),
 t AS (SELECT target_id, cadence, CASE WHEN any_value(s) < 1e-12 OR sum(w) = 0 THEN any_value(m) ELSE sum(w * y) / sum(w) END AS v FROM w GROUP BY 1, 2),
 g AS (SELECT x.target_id, x.segment_id, x.cadence, time_days, f, n, used, mid, CASE WHEN v IS NOT NULL AND time_days > t0 + h AND time_days < t1 - h THEN {{'t': time_days, 'v': v}} END AS good FROM x JOIN s USING (target_id, segment_id) LEFT JOIN t ON t.target_id = x.target_id AND t.cadence = x.cadence),
 i AS (SELECT *, last_value(good IGNORE NULLS) OVER (PARTITION BY target_id, segment_id ORDER BY time_days, cadence ROWS UNBOUNDED PRECEDING) AS a, first_value(good IGNORE NULLS) OVER (PARTITION BY target_id, segment_id ORDER BY time_days, cadence ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g),
 r AS (SELECT *, CASE WHEN n <= 3 THEN f WHEN used < 3 OR (a IS NULL AND b IS NULL) THEN mid WHEN a IS NULL THEN b.v WHEN b IS NULL OR b.t = a.t THEN a.v ELSE a.v + (b.v - a.v) * (time_days - a.t) / (b.t - a.t) END AS trend FROM i)
 SELECT target_id, cadence, time_days, segment_id, round(CASE WHEN trend > 0 THEN trend ELSE 1 END, 6) AS trend, round(f / CASE WHEN trend > 0 THEN trend ELSE 1 END, 6) AS flux_detrended FROM (SELECT target_id, cadence, round(time_days, 6) AS time_days, segment_id, f, trend FROM r)""")
def two_pass_detrend(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("target_id"), F.lit(1.3).alias("epoch"), F.lit(4.7).alias("period"), F.lit(0.3).alias("duration"))
    return rounded(X.two_pass(wide_prep(spark, d), c, 3.0))


@query(f"""{WIDE_PREP}, g AS (SELECT CAST(k AS INT) AS k, 1 / (1.0::DOUBLE / 2 + k * ((1.0::DOUBLE / 10 - 1.0::DOUBLE / 2) / 59)) AS p FROM range(60) r(k)), a AS (SELECT target_id, avg(flux_norm) AS m, count(*) AS total FROM prep GROUP BY 1),
 b AS (SELECT target_id, k, CAST(floor((time_days - p * floor(time_days / p)) / p * 20) AS INT) AS bin, count(*) AS n, sum(flux_norm - m) AS s FROM prep JOIN a USING (target_id), g GROUP BY 1, 2, 3),
 mj AS (SELECT unnest([1, 2, 2, 3, 3, 3]) AS m, unnest([0, 0, 1, 0, 1, 2]) AS j), x AS (SELECT target_id, k, m, (bin - j + 20) % 20 AS b, sum(n) AS n, sum(s) AS s FROM b, mj GROUP BY 1, 2, 3, 4),
 pw AS (SELECT x.*, round(CASE WHEN s < 0 AND n < total THEN s * s / (n * (1 - n / total::DOUBLE)) ELSE 0 END, 6) AS power FROM x JOIN a USING (target_id))
 SELECT target_id, CAST(k AS BIGINT) AS period_index, CAST(m AS BIGINT) AS width, CAST(b AS BIGINT) AS bin, power FROM pw QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY power DESC, k, m, b) = 1""")
def bls_relational(spark, d):
    return X.relational_bls(wide_prep(spark, d), 60, 2.0, 10.0)


@query(f"""{WIDE_PREP}, a AS (SELECT target_id, avg(flux_norm) AS m FROM prep GROUP BY 1), x AS (SELECT target_id, k, flux_norm - m AS y, cos(2 * pi() * 0.02 * k * time_days) AS c, sin(2 * pi() * 0.02 * k * time_days) AS s FROM prep JOIN a USING (target_id), range(1, 31) r(k)),
 q AS (SELECT target_id, k, avg(c) AS c, avg(s) AS s, avg(y * c) AS yc, avg(y * s) AS ys, avg(c * c) - avg(c) ** 2 AS cc, avg(s * s) - avg(s) ** 2 AS ss, avg(c * s) - avg(c) * avg(s) AS cs, avg(y * y) AS yy FROM x GROUP BY 1, 2)
 SELECT target_id, CAST(k AS BIGINT) AS k, round(CASE WHEN cc * ss - cs * cs > 1e-9 AND yy > 0 THEN least(greatest((ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / ((cc * ss - cs * cs) * yy), 0), 1) ELSE 0 END, 5) AS power FROM q""")
def lomb_scargle_relational(spark, d):
    return rounded(X.relational_lomb_scargle(wide_prep(spark, d), 30, 0.02), 5)


@query()
def lomb_scargle(spark, d):
    return rounded(X.lomb_scargle_best(wide_prep(spark, d), 0.5))


@query("SELECT s_suppkey AS id, i AS k, round(1.0::DOUBLE * pow((least(24.0, 0.25 * (10 + s_suppkey % 50))) / 1.0, i / 7.0::DOUBLE), 9) AS duration FROM supplier, range(8) r(i)")
def duration_grid(spark, d):
    top = F.least(F.lit(24.0), 0.25 * (10 + F.col("s_suppkey") % 50))
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), top.alias("top"))
    return rounded(x.select("id", "k", F.pow("top", F.col("k") / 7).alias("duration")), 9)


@query("""SELECT s_suppkey AS id, i AS k, round(1 / (1.0::DOUBLE / 2 - i * (0.1::DOUBLE / (100.0 + s_suppkey % 30))), 9) AS period FROM supplier, range(2000) r(i) WHERE i <= floor((1.0::DOUBLE / 2 - 1.0::DOUBLE / 20) / (0.1::DOUBLE / (100.0 + s_suppkey % 30)))""")
def period_grid(spark, d):
    """Trial periods, uniform in frequency, from half the longest frequency step down; exploded in the plan."""
    step = 0.1 / (100.0 + F.col("s_suppkey") % 30)
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), step.alias("step")).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((1 / 2 - 1 / 20) / F.col("step")).cast("int"))))
    return rounded(x.select("id", "k", (1 / (1 / 2 - F.col("k") * F.col("step"))).alias("period")), 9)


# --- signals planted in quiet versions of the long curves -------------------------------


def planted(spark, d):
    """Long curves with a hundredth of their scatter and a dip of 2 % planted at the supplier's ephemeris."""
    prep = P.prepared(lineitem_curve(spark, d), 12.0, sigma=2.0, mask=4)
    x = prep.join(supplier_candidates(spark, d).select("target_id", "epoch", "period", "duration"), "target_id")
    dip = S.trapezoid(S.phase_days(F.col("time_days"), F.col("epoch"), F.col("period")), 0.02, F.col("duration"), 0.2)
    return x.withColumn("flux_norm", (1 + (F.col("flux_norm") - 1) * 0.002) * dip).drop("epoch", "period", "duration")


#: Every trial period of the grid: some 20,000 for a curve of seven years.
GRID = K.Grid(least=15.0, largest=65.0, least_duration=3.0, most_duration=7.0, durations=4)


@query()
def candidate_search(spark, d):
    return rounded(X.candidates(planted(spark, d), most=2, grid=GRID))


@query()
def trapezoid_fit(spark, d):
    p = planted(spark, d)
    return rounded(X.refined(p, X.candidates(p, most=1, grid=GRID)))


@query()
def bootstrap_intervals(spark, d):
    p = planted(spark, d)
    return rounded(X.bootstrap(p, X.refined(p, X.candidates(p, most=1, grid=GRID)), replicates=12))


@query()
def permutation_pvalue(spark, d):
    return rounded(X.permutation_test(wide_prep(spark, d), 20, 20, 19))


# --- signals planted in the suppliers' own curves, quieted ------------------------------

PERIODS, DEPTHS = (21.0, 34.0), (0.02, 0.05)
TRIALS_SQL = """trial AS (SELECT s_suppkey || '_' || CASE WHEN i = 4 THEN 'control' ELSE 'p' || i // 2 || '_d' || i % 2 END AS trial_id, s_suppkey AS target_id, [21.0, 21.0, 34.0, 34.0, NULL][i + 1]::DOUBLE AS period, [0.02, 0.05, 0.02, 0.05, NULL][i + 1]::DOUBLE AS depth FROM supplier, range(5) r(i)),
 planned AS (SELECT *, CAST('0x' || substr(sha256('study:' || trial_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS share FROM trial)"""


def quiet_curves(spark, d):
    prep = P.prepared(lineitem_curve(spark, d), 12.0, sigma=2.0, mask=4)
    return prep.select("target_id", "cadence", "time_days", (1 + (F.col("flux_norm") - 1) * 0.002).alias("flux_norm"))


@query(f"""{LINEITEM_PREP}, {TRIALS_SQL}, c AS (SELECT target_id, time_days, 1 + (flux_norm - 1) * 0.002 AS x FROM prep), st AS (SELECT target_id, min(time_days) AS t0 FROM c GROUP BY 1),
 y AS (SELECT trial_id, p.target_id, period, depth, time_days, x, t0 + share * period AS e FROM planned p JOIN st USING (target_id) JOIN c USING (target_id)),
 z AS (SELECT *, CASE WHEN period IS NULL THEN x ELSE x * (1 - depth * greatest(0, least(1, (2.5 - abs((time_days - e + period / 2) - period * floor((time_days - e + period / 2) / period) - period / 2)) / 0.5))) END AS f FROM y)
 SELECT trial_id, target_id, count(*) AS n, round(any_value(e), 6) AS truth_epoch, round(sum(f), 4) AS flux_sum, round(min(f), 6) AS lowest FROM z GROUP BY 1, 2""")
def injection_curves(spark, d):
    """Every supplier's curve with each of four signals, and without one."""
    c = quiet_curves(spark, d)
    x = J.injected(c, J.trials(table(spark, d, "supplier").select(F.col("s_suppkey").alias("target_id")), PERIODS, DEPTHS, "study"), 5.0)
    return x.groupBy("trial_id", "target_id").agg(F.count("*").alias("n"), F.round(F.max("truth_epoch"), 6).alias("truth_epoch"), F.round(F.sum("flux_norm"), 4).alias("flux_sum"), F.round(F.min("flux_norm"), 6).alias("lowest"))


@query()
def injection_recovery(spark, d):
    """The study of all trials, in blocks, by signal and band of SNR."""
    c = quiet_curves(spark, d)
    planned = J.trials(table(spark, d, "supplier").select(F.col("s_suppkey").alias("target_id")), PERIODS, DEPTHS, "study")
    work = lambda part: J.searched_trials(c, part, 5.0, K.Grid(18.0, 60.0, 4.0, 7.0, 3), least_snr=6.0, hours=30.0)
    outcomes, _ = J.run_study(planned, stream.shared_folder(spark, "study"), 2, work)
    return J.recovery(outcomes)


# --- pixels: embeddings as 8 x 8 stamps -------------------------------------------------

PIXEL_SQL = """frames AS (SELECT CAST(label // 2 AS BIGINT) AS target_id, vec_id AS frame, label % 2 = 1 AS in_event, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings WHERE embedding IS NOT NULL),
 pix AS (SELECT target_id, frame, in_event, i // 8 AS row, i % 8 AS col, abs(v::DOUBLE) AS flux FROM frames),
 diff AS (SELECT target_id, row, col, avg(flux) FILTER (NOT in_event) - avg(flux) FILTER (in_event) AS difference FROM pix GROUP BY 1, 2, 3),
 off AS (SELECT target_id, sum(greatest(difference, 0)) AS total, sqrt((sum(greatest(difference, 0) * col) / sum(greatest(difference, 0)) - 4) ** 2 + (sum(greatest(difference, 0) * row) / sum(greatest(difference, 0)) - 4) ** 2) AS offset_pixels FROM diff GROUP BY 1),
 ap AS (SELECT target_id, frame, in_event, sum(CASE WHEN sqrt((col - 4) ** 2 + (row - 4) ** 2) <= 1.2 THEN flux ELSE 0 END) AS core, sum(CASE WHEN sqrt((col - 4) ** 2 + (row - 4) ** 2) <= 2.8 THEN flux ELSE 0 END) AS wide FROM pix GROUP BY 1, 2, 3),
 md AS (SELECT target_id, count(*) FILTER (in_event) AS frames_in, count(*) FILTER (NOT in_event) AS frames_out, greatest(0, 1 - median(core) FILTER (in_event) / median(core) FILTER (NOT in_event)) AS core_depth, greatest(0, 1 - median(wide) FILTER (in_event) / median(wide) FILTER (NOT in_event)) AS wide_depth FROM ap GROUP BY 1),
 gr AS (SELECT *, CASE WHEN core_depth > 1e-5 THEN wide_depth / core_depth END AS growth FROM md)"""


def stamps(spark, d):
    e = table(spark, d, "embeddings").filter("embedding IS NOT NULL")
    frames = e.select(F.floor(F.col("label") / 2).alias("target_id"), F.col("vec_id").alias("frame"), (F.col("label") % 2 == 1).alias("in_event"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("stamp"))
    return X.pixel_rows(frames, 8)


@query(f"WITH {PIXEL_SQL} SELECT target_id, row, col, round(difference, 6) AS difference FROM diff")
def difference_image(spark, d):
    return rounded(X.difference_image(stamps(spark, d)))


@query(f"WITH {PIXEL_SQL} SELECT target_id, frames_in, frames_out, round(core_depth, 6) AS core_depth, round(wide_depth, 6) AS wide_depth, round(growth, 6) AS growth FROM gr")
def aperture_growth(spark, d):
    return rounded(X.aperture_growth(stamps(spark, d), 8))


@query(f"""WITH {PIXEL_SQL} SELECT target_id, CASE WHEN frames_in < 3 OR frames_out < 10 THEN NULL WHEN (offset_pixels >= 0.5 AND offset_pixels / 0.1 >= 3) OR coalesce(growth >= 1.4 AND offset_pixels >= 0.3, false) THEN 'blend_suspected' WHEN offset_pixels < 0.5 AND offset_pixels / 0.1 < 3 THEN 'target_consistent' ELSE 'unresolved' END AS assessment,
 round(offset_pixels, 6) AS offset_pixels, round(growth, 6) AS growth FROM off JOIN gr USING (target_id)""")
def vet_tier2(spark, d):
    return rounded(X.vet_tier2(stamps(spark, d), 8, 0.1))


# --- sequences and downsampling ---------------------------------------------------------


@query(FOLD_SQL + """, r AS (SELECT *, phase / duration AS rr FROM fold WHERE abs(phase / duration) <= 5), rm AS (SELECT target_id, median(flux_norm) AS m FROM r GROUP BY 1), rs AS (SELECT r.target_id, any_value(m) AS m, 1.4826 * median(abs(flux_norm - m)) AS s FROM r JOIN rm USING (target_id) GROUP BY 1),
 b AS (SELECT r.target_id, CAST(least(floor((rr + 5) / 10 * 64), 63) AS BIGINT) AS bin, least(greatest((flux_norm - m) / CASE WHEN s > 2.220446049250313e-16 THEN s ELSE 1 END, -10), 10) AS z FROM r JOIN rs USING (target_id)),
 g AS (SELECT target_id, bin, median(z) AS flux, count(*) AS n FROM b GROUP BY 1, 2), al AS (SELECT DISTINCT target_id, i AS bin FROM g, range(64) q(i)), o AS (SELECT al.target_id, al.bin, coalesce(flux, 0) AS flux, coalesce(n, 0) AS n FROM al LEFT JOIN g USING (target_id, bin))
 SELECT target_id, bin, round(flux, 6) AS flux, round(n / max(n) OVER (PARTITION BY target_id)::DOUBLE, 6) AS occupancy FROM o""")
def candidate_sequence(spark, d):
    return rounded(X.candidate_sequence(lineitem_fold(spark, d), bins=64))


@query(f"""WITH {LINEITEM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY time_days, cadence) - 1 AS rn, count(*) OVER (PARTITION BY target_id) AS n FROM curve), b AS (SELECT *, rn // CAST(ceil(n / 50.0) AS BIGINT) AS b FROM r),
 x AS (SELECT target_id, cadence, flux, row_number() OVER (PARTITION BY target_id, b ORDER BY flux, time_days, cadence) AS lo, row_number() OVER (PARTITION BY target_id, b ORDER BY flux DESC, time_days, cadence) AS hi, n FROM b) SELECT target_id, cadence, flux FROM x WHERE n <= 100 OR lo = 1 OR hi = 1""")
def minmax_downsample(spark, d):
    return X.minmax_downsample(lineitem_curve(spark, d).select("target_id", "time_days", "cadence", "flux"), 100).select("target_id", "cadence", "flux")


@query()
def lttb_downsample(spark, d):
    return X.lttb_downsample(lineitem_curve(spark, d), 100)


# --- combination ------------------------------------------------------------------------


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT DISTINCT target_id, product_id, time_days FROM curve), s AS (SELECT *, time_days - lag(time_days) OVER (PARTITION BY target_id, product_id ORDER BY time_days) AS dt FROM t) SELECT target_id, product_id, round(CASE WHEN count(*) >= 3 THEN quantile_disc(dt, 0.5) END, 6) AS width_days FROM s GROUP BY 1, 2""")
def cadence_width(spark, d):
    return rounded(X.cadence_width(events_curve(spark, d), ["target_id", "product_id"]))


@query()
def overlap_resolution(spark, d):
    return X.resolve_overlaps(events_curve(spark, d), 0.2)


@query(f"WITH {EVENTS_SQL} SELECT target_id, product_id, cadence, row_number() OVER (PARTITION BY target_id ORDER BY time_days, product_id, cadence) - 1 AS place FROM curve")
def stitch(spark, d):
    return X.stitch(events_curve(spark, d)).select("target_id", "product_id", "cadence", "place")


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT target_id, product_id, median(flux) AS m FROM curve GROUP BY 1, 2), c AS (SELECT c.target_id, c.product_id, cadence, time_days, flux / m AS flux_norm FROM curve c JOIN m USING (target_id, product_id) WHERE m > 0)
 SELECT target_id, product_id, cadence, round(flux_norm, 6) AS flux_norm, row_number() OVER (PARTITION BY target_id ORDER BY time_days, product_id, cadence) - 1 AS place FROM c""")
def combined_preparation(spark, d):
    """Every product normalized by itself, then all as one series."""
    from pyspark.sql import Window

    c = events_curve(spark, d).withColumn("_m", F.median("flux").over(Window.partitionBy("target_id", "product_id"))).filter("_m > 0")
    return rounded(X.stitch(c.withColumn("flux_norm", F.col("flux") / F.col("_m"))).select("target_id", "product_id", "cadence", "flux_norm", "place"))


@query(SQL["biweight_trend"])
def table_function_trend(spark, d):
    """The trend by its table function, from SQL."""
    wide_prep(spark, d).createOrReplaceTempView("starfold_wide_prep")
    call = "sliding_trend(TABLE(starfold_wide_prep) PARTITION BY target_id ORDER BY (time_days, cadence), key => 'target_id', flux => 'flux_norm', id => 'cadence', window => 3.0D, gap => 2.0D)"
    return rounded(tables.register(spark).sql(f"SELECT target_id, row AS cadence, trend, flux_detrended FROM {call}"))


# --- streams ----------------------------------------------------------------------------


def _event_stream(spark, d):
    return stream.read_files(spark, d, "events.parquet", table(spark, d, "events").schema)


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
 SELECT user_id AS target_id, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM g GROUP BY user_id, k""")
def stream_sessions(spark, d):
    s = _event_stream(spark, d).select(F.col("user_id").alias("target_id"), F.col("ts").cast("timestamp").alias("ts"))
    done = stream.run_to_end(spark, stream.sessions(s, "ts", "target_id", "6 hours"))
    return done.select("target_id", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("SELECT user_id AS target_id, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def stream_target_stats(spark, d):
    s = _event_stream(spark, d).select(F.col("user_id").alias("target_id"), "value")
    return stream.run_to_end(spark, stream.target_statistics(s, "target_id", "value"))
