"""Folded measurements of candidates, and the vector of 25 features.

A candidate is a row (target_id, epoch, period, duration, depth, ...): days, and a depth
relative to 1. Cadences meet candidates in one join by target; each measurement is then
grouped aggregates over the fold.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators.prepare import mad_of, median_of
from starfold.session import materialize

KEY = ["target_id"]
X = "flux_norm"


def folded(curve: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cadences with their candidate's columns, ``phase`` (days), ``fraction`` (of the period), ``half``, ``cycle``, ``inside`` and ``outside``."""
    x = curve.join(candidates, KEY)
    t, e, p = F.col("time_days"), F.col("epoch"), F.col("period")
    x = x.withColumns({"phase": S.phase_days(t, e, p), "fraction": S.phase_fraction(t, e, p), "cycle": S.cycle_index(t, e, p), "half": 0.5 * F.col("duration") / p})
    return x.withColumns({"inside": F.abs("fraction") <= F.col("half"), "outside": F.abs("fraction") > 1.2 * F.col("half")})


def transit_mask(curve: DataFrame, candidates: DataFrame, buffer: float = 1.5) -> DataFrame:
    """Add ``masked``: within ``buffer`` half durations of any event; periods and durations that aren't positive don't count."""
    good = candidates.filter((F.col("period") > 0) & (F.col("duration") > 0)).groupBy(*KEY).agg(F.collect_list(F.struct("epoch", "period", "duration")).alias("_events"))
    hit = F.exists("_events", lambda c: F.abs(S.phase_days(F.col("time_days"), c["epoch"], c["period"])) <= 0.5 * c["duration"] * buffer)
    return curve.join(good, KEY, "left").withColumn("masked", F.coalesce(hit, F.lit(False))).drop("_events")


def binned_median(fold: DataFrame, bins: int = 30) -> DataFrame:
    """Median flux of each non-empty phase bin; bins span the larger of two hours and 3.5 durations on either side."""
    half = F.greatest(F.lit(2 / 24), 3.5 * F.col("duration"))
    at = F.floor((F.col("phase") + half) / (2 * half) * bins).cast("bigint")
    inside = fold.withColumn("bin", at).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    return inside.groupBy(*KEY, "bin").agg(F.median(X).alias("flux"), F.count("*").alias("n"))


def event_depths(fold: DataFrame, least: int = 3) -> DataFrame:
    """Depth of each event with at least ``least`` cadences: one less their median."""
    return fold.filter("inside").groupBy(*KEY, "cycle").agg(F.count("*").alias("n"), (1 - F.median(X)).alias("event_depth")).filter(F.col("n") >= least)


def morphology(fold: DataFrame) -> DataFrame:
    """Shape by the fitted ingress, duration by period, asymmetry of ingress and egress (two cadences of each at least)."""
    one = lambda c: F.max(c)  # noqa: E731  a candidate's own columns are the same on all of its cadences
    before, after = F.col("inside") & (F.col("fraction") < 0), F.col("inside") & (F.col("fraction") >= 0)
    x = F.col(X)
    skew = F.abs(F.avg(F.when(before, x)) - F.avg(F.when(after, x))) / F.greatest(one("depth"), F.lit(1e-5))
    enough = (F.count_if(before) >= 2) & (F.count_if(after) >= 2)
    return fold.groupBy(*KEY).agg(
        one("ingress").alias("v_shape_ratio"),
        (one("duration") / one("period")).alias("duration_to_period_ratio"),
        (1 - one("ingress")).alias("boxiness_index"),
        F.when(enough, skew).otherwise(0.0).alias("asymmetry_score"),
        F.coalesce(one("delta_bic"), F.lit(0.0)).alias("batman_vs_trapezoid_delta_bic"),
    )


def odd_even(fold: DataFrame) -> DataFrame:
    """Difference of the mean in-transit flux of odd and even events in standard errors; 0 under three cadences of either."""
    odd = F.pmod(F.col("cycle"), F.lit(2)) == 1
    one, two = F.when(F.col("inside") & odd, F.col(X)), F.when(F.col("inside") & ~odd, F.col(X))
    m = fold.groupBy(*KEY).agg(F.avg(one).alias("a"), F.avg(two).alias("b"), F.count(one).alias("n"), F.count(two).alias("m"), F.var_pop(one).alias("va"), F.var_pop(two).alias("vb"))
    error = F.sqrt(F.greatest(F.lit(1e-12), F.col("va") / F.col("n") + F.col("vb") / F.col("m")))
    return m.select(*KEY, F.when((F.col("n") >= 3) & (F.col("m") >= 3), F.abs(F.col("a") - F.col("b")) / error).otherwise(0.0).alias("odd_even_depth_sigma"))


def depth_scatter(fold: DataFrame) -> DataFrame:
    """Number of events, and 1.4826 * MAD of their depths by the median depth; 0.1 under two events."""
    d = event_depths(fold).withColumn("_m", F.median("event_depth").over(Window.partitionBy(*KEY)))
    g = d.groupBy(*KEY).agg(F.count("*").cast("double").alias("observed_event_count"), F.max("_m").alias("m"), F.median(F.abs(F.col("event_depth") - F.col("_m"))).alias("mad"))
    return g.select(*KEY, "observed_event_count", F.when(F.col("observed_event_count") >= 2, S.MAD_SCALE * F.col("mad") / F.greatest(F.lit(1e-5), F.col("m"))).otherwise(0.1).alias("per_transit_depth_mad_ratio"))


def phase_coverage(fold: DataFrame, bins: int = 20) -> DataFrame:
    """Share of occupied bins of phase by half duration over [-1, 1]; the last bin is closed."""
    x = F.col("phase") / (F.col("duration") / 2)
    at = F.least(F.floor((x + 1) / 2 * bins), F.lit(bins - 1))
    return fold.groupBy(*KEY).agg((F.count_distinct(F.when(F.abs(x) <= 1, at)) / bins).alias("phase_coverage_fraction"))


def duty_cycle(fold: DataFrame) -> DataFrame:
    """Events with three cadences or more, by those that fit between the first and the last cadence."""
    last, first = F.floor((F.max("time_days") - F.max("epoch")) / F.max("period")), F.ceil((F.min("time_days") - F.max("epoch")) / F.max("period"))
    expected = fold.groupBy(*KEY).agg(F.greatest(F.lit(1), last - first + 1).cast("bigint").alias("expected"))
    seen = event_depths(fold).groupBy(*KEY).agg(F.count("*").alias("observed"))
    both = expected.join(seen, KEY, "left").select(*KEY, "expected", F.coalesce("observed", F.lit(0)).alias("observed"))
    return both.select(*KEY, "observed", "expected", F.least(F.col("observed") / F.col("expected"), F.lit(1.0)).alias("in_transit_duty_cycle"))


def outside_scatter(fold: DataFrame) -> DataFrame:
    """Robust scatter out of transit, at least 1e-6; 1e-3 under eleven cadences."""
    o = fold.filter("outside").withColumn("_m", F.median(X).over(Window.partitionBy(*KEY)))
    g = o.groupBy(*KEY).agg(F.count("*").alias("n"), F.median(F.abs(F.col(X) - F.col("_m"))).alias("mad"))
    return g.select(*KEY, F.greatest(F.lit(1e-6), F.when(F.col("n") > 10, S.MAD_SCALE * F.col("mad")).otherwise(1e-3)).alias("scatter"))


def secondary_scan(fold: DataFrame, centres: int = 9) -> DataFrame:
    """The strongest dip of ``centres`` phases from 0.35 to 0.5, the first of equals; nothing under five cadences there."""
    far = fold.filter(F.col("outside") & (F.abs("fraction") >= 0.35))
    step = 0.15 / (centres - 1)
    spot = F.explode(F.sequence(F.lit(0), F.lit(centres - 1)))
    near = F.abs(F.abs("fraction") - (0.35 + F.col("k") * step)) <= F.col("half")
    each = far.withColumn("k", spot).filter(near).groupBy(*KEY, "k").agg((1 - F.avg(X)).alias("dip"), F.count("*").alias("n")).filter("n >= 3")
    each = each.join(outside_scatter(fold), KEY).withColumn("snr", F.round(F.col("dip") / (F.col("scatter") / F.sqrt("n")), 9)).filter("snr > 0")
    best = each.groupBy(*KEY).agg(F.max_by(F.struct("snr", "dip", "k"), F.struct("snr", -F.col("k"))).alias("b"))
    base = fold.groupBy(*KEY).agg(F.greatest(F.max("depth"), F.lit(1e-5)).alias("depth"), F.count_if(F.col("outside") & (F.abs("fraction") >= 0.35)).alias("n"))
    x = base.join(best, KEY, "left").withColumn("ok", (F.col("n") >= 5) & F.col("b").isNotNull())
    zero = lambda c: F.when(F.col("ok"), c).otherwise(0.0)
    return x.select(*KEY, zero(F.col("b.snr")).alias("max_secondary_snr"), zero(F.greatest(F.col("b.dip"), F.lit(0.0)) / F.col("depth")).alias("secondary_to_primary_depth_ratio"), zero(0.15 - F.col("b.k") * step).alias("secondary_phase_offset_from_half"))


def ellipsoidal(fold: DataFrame) -> DataFrame:
    """Amplitude of the double-frequency wave out of transit, by depth; 0 under twenty cadences."""
    o = fold.filter("outside").withColumns({"_c": F.cos(4 * pi * F.col("fraction")), "_v": F.col(X) - F.avg(X).over(Window.partitionBy(*KEY))})
    g = o.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("d"), (-F.sum(F.col("_v") * F.col("_c"))).alias("a"), F.greatest(F.max("depth"), F.lit(1e-5)).alias("depth"))
    good = (F.col("n") >= 20) & (F.col("d") > 1e-6)
    return g.select(*KEY, F.when(good, F.greatest(F.col("a") / F.col("d"), F.lit(0.0)) / F.col("depth")).otherwise(0.0).alias("ellipsoidal_amplitude_ratio"))


def outside_rms(fold: DataFrame) -> DataFrame:
    """Standard deviation out of transit by depth; 1 under ten cadences."""
    x = F.when(F.col("outside"), F.col(X))
    return fold.groupBy(*KEY).agg(F.when(F.count(x) >= 10, F.stddev_pop(x) / F.greatest(F.max("depth"), F.lit(1e-5))).otherwise(1.0).alias("out_of_transit_rms_to_depth_ratio"))


def red_noise_beta(fold: DataFrame) -> DataFrame:
    """Scatter of means of blocks of one duration's cadences, by that of white noise; 1 under five blocks."""
    w = Window.partitionBy(*KEY).orderBy("time_days", "cadence")
    steps = fold.select(*KEY, (F.col("time_days") - F.lag("time_days").over(w)).alias("dt"))
    dt = steps.filter("dt > 0").groupBy(*KEY).agg(F.median("dt").alias("dt"))
    middle = fold.withColumn("_m", F.median(X).over(Window.partitionBy(*KEY))).groupBy(*KEY).agg(F.max("duration").alias("duration"), F.greatest(F.lit(1e-6), S.MAD_SCALE * F.median(F.abs(F.col(X) - F.col("_m")))).alias("white"))
    sizes = middle.join(dt, KEY, "left").select(*KEY, "white", F.greatest(F.lit(1), F.rint(F.greatest(F.lit(1.0), F.col("duration") / F.greatest(F.lit(1e-5), F.coalesce("dt", F.lit(2 / 1440)))))).cast("int").alias("size"))
    o = fold.filter("NOT inside").withColumn("_r", F.row_number().over(w) - 1).join(sizes, KEY)
    means = o.groupBy(*KEY, "size", "white", F.floor(F.col("_r") / F.col("size")).alias("_b")).agg(F.avg(X).alias("m"), F.count("*").alias("n")).filter("n = size")
    g = means.groupBy(*KEY).agg(F.count("*").alias("blocks"), F.stddev_pop("m").alias("sigma"), F.max("white").alias("white"), F.max("size").alias("size"))
    return g.select(*KEY, F.when(F.col("blocks") >= 5, F.col("sigma") / F.greatest(F.lit(1e-6), F.col("white") / F.sqrt("size"))).otherwise(1.0).alias("red_noise_beta_factor"))


def red_noise_snr(fold: DataFrame, block: int) -> DataFrame:
    """Depth by sqrt(white^2 / points + red^2 / events): the red part is what block means scatter beyond white noise."""
    w = Window.partitionBy(*KEY).orderBy("time_days", "cadence")
    o = fold.filter("outside").withColumn("_b", F.floor((F.row_number().over(w) - 1) / block))
    white = o.groupBy(*KEY).agg(F.stddev_pop(X).alias("white"))
    means = o.groupBy(*KEY, "_b").agg(F.avg(X).alias("m"), F.count("*").alias("n")).filter(F.col("n") == block).groupBy(*KEY).agg(F.stddev_pop("m").alias("sigma"))
    inside = fold.groupBy(*KEY).agg(F.count_if("inside").alias("points"), F.count_distinct(F.when(F.col("inside"), F.col("cycle"))).alias("events"), F.max("depth").alias("depth"))
    red = F.greatest(F.col("sigma") * F.col("sigma") - F.col("white") * F.col("white") / block, F.lit(0.0))
    noise = F.sqrt(F.try_divide(F.col("white") * F.col("white"), F.col("points")) + F.try_divide(red, F.col("events")))
    return white.join(means, KEY).join(inside, KEY).select(*KEY, F.try_divide(F.col("depth"), noise).alias("red_noise_snr"))


def lag_autocorrelation(fold: DataFrame) -> DataFrame:
    """Mean product of deviations from 1 a period apart, by the variance.

    A cadence's partner is the first one at or after its time plus a period, or the last one
    of all, if it lies within the larger of 0.01 days and a fifth of the duration.
    """
    spot = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    t = F.col("time_days")
    spots = fold.select(*KEY, "cadence", F.col(X).alias("x"), "duration", F.explode(F.array(spot(t + F.col("period"), 0), spot(t, 1))).alias("s")).select(*KEY, "cadence", "x", "duration", "s.*")
    w = Window.partitionBy(*KEY).orderBy(F.desc("at"), F.desc("kind"), F.desc("cadence")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.last(F.when(F.col("kind") == 1, F.struct("at", "x")), ignorenulls=True).over(w)  # from the end on, so that one value is carried along
    both = spots.withColumn("ahead", ahead).filter("kind = 0")
    near = F.abs(F.col("ahead.at") - F.col("at")) <= F.greatest(F.lit(0.01), 0.2 * F.col("duration"))
    pairs = both.filter(near).groupBy(*KEY).agg(F.count("*").alias("pairs"), F.avg((F.col("x") - 1) * (F.col("ahead.x") - 1)).alias("cov"))
    base = fold.groupBy(*KEY).agg(F.count("*").alias("n"), F.var_pop(X).alias("v"))
    ok = (F.col("n") >= 50) & (F.col("pairs") >= 10) & (F.col("v") > 1e-12)
    return base.join(pairs, KEY, "left").select(*KEY, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce(F.when(ok, S.clip(F.col("cov") / F.col("v"), -1, 1)), F.lit(0.0)).alias("autocorrelation_at_period"))


def gap_proximity(fold: DataFrame, hours: float = 1.0) -> DataFrame:
    """Share of in-transit cadences within ``hours`` of any segment's first or last cadence.

    The nearest boundary of a cadence is one of its own segment.
    """
    w = Window.partitionBy(*KEY, "segment_id")
    near = F.least(F.col("time_days") - F.min("time_days").over(w), F.max("time_days").over(w) - F.col("time_days"))
    x = fold.withColumn("_near", near)
    share = F.coalesce(F.try_divide(F.count_if(F.col("inside") & (F.col("_near") <= hours / 24)), F.count_if("inside")), F.lit(0.0))
    return x.groupBy(*KEY).agg(share.alias("gap_proximity_fraction"))


def flagged_fraction(fold: DataFrame) -> DataFrame:
    """Share of in-transit cadences with any quality bit; meant for all cadences, before they are filtered."""
    return fold.groupBy(*KEY).agg(F.coalesce(F.try_divide(F.count_if(F.col("inside") & (F.col("quality") != 0)), F.count_if("inside")), F.lit(0.0)).alias("in_transit_flagged_fraction"))


def centroid_shift(fold: DataFrame) -> DataFrame:
    """Shift of the mean centroid in transit against out of it, in pixels and in standard errors; null under 3 in and 10 out."""
    ok = F.col("centroid_column").isNotNull() & F.col("centroid_row").isNotNull()
    cols = []
    for axis in ("column", "row"):
        for name, cond in (("in", F.col("inside")), ("out", ~F.col("inside"))):
            x = F.when(ok & cond, F.col(f"centroid_{axis}"))
            cols += [F.avg(x).alias(f"{axis}_{name}"), F.try_divide(F.var_pop(x), F.count(x)).alias(f"{axis}_{name}_e"), F.count(x).alias(f"{axis}_{name}_n")]
    m = fold.groupBy(*KEY).agg(*cols)
    dx, dy = F.col("column_in") - F.col("column_out"), F.col("row_in") - F.col("row_out")
    error = F.sqrt(F.greatest(F.lit(1e-12), F.col("column_in_e") + F.col("column_out_e") + F.col("row_in_e") + F.col("row_out_e")))
    enough = (F.col("column_in_n") >= 3) & (F.col("column_out_n") >= 10)
    shift = F.sqrt(dx * dx + dy * dy)
    return m.select(*KEY, F.when(enough, shift).alias("shift_pixels"), F.when(enough, shift / error).alias("centroid_shift_sigma"))


def delivered_depth_ratio(fold: DataFrame, delivered: str = "flux_delivered") -> DataFrame:
    """Median depth in transit before detrending by that after; 1 under three cadences."""
    before, after = (F.median(F.when(F.col("inside"), F.col(c))) for c in (delivered, X))
    ratio = F.greatest(F.lit(0.0), 1 - before) / F.greatest(F.lit(1e-5), 1 - after)
    return fold.groupBy(*KEY).agg(F.when(F.count_if("inside") >= 3, ratio).otherwise(1.0).alias("sap_to_pdcsap_depth_ratio"))


def vet_tier1(fold: DataFrame) -> DataFrame:
    """Off target beyond 3.5 sigma and 0.2 pixels; unresolved if the shift or the crowding is unknown, or the crowding below 0.85."""
    x = centroid_shift(fold).join(fold.groupBy(*KEY).agg(F.max("crowding").alias("crowding")), KEY)
    off = (F.col("centroid_shift_sigma") > 3.5) & (F.col("shift_pixels") > 0.2)
    unsure = F.col("shift_pixels").isNull() | F.col("crowding").isNull() | (F.col("crowding") < 0.85)
    return x.select(*KEY, F.when(off, "off_target").when(unsure, "unresolved").otherwise("on_target").alias("assessment"), "shift_pixels", "centroid_shift_sigma")


#: Name, default, least and greatest value of each feature, by family.
FEATURES = [
    ("v_shape_ratio", 0.5, 0.0, 1.0),
    ("duration_to_period_ratio", 0.02, 0.0, 1.0),
    ("boxiness_index", 0.5, 0.0, 1.0),
    ("asymmetry_score", 0.0, 0.0, 10.0),
    ("batman_vs_trapezoid_delta_bic", 0.0, -1000.0, 1000.0),
    ("odd_even_depth_sigma", 0.0, 0.0, 100.0),
    ("per_transit_depth_mad_ratio", 0.1, 0.0, 10.0),
    ("phase_coverage_fraction", 1.0, 0.0, 1.0),
    ("in_transit_duty_cycle", 1.0, 0.0, 1.0),
    ("observed_event_count", 1.0, 0.0, 1000.0),
    ("max_secondary_snr", 0.0, 0.0, 1000.0),
    ("secondary_to_primary_depth_ratio", 0.0, 0.0, 10.0),
    ("secondary_phase_offset_from_half", 0.0, 0.0, 0.5),
    ("ellipsoidal_amplitude_ratio", 0.0, 0.0, 5.0),
    ("ls_max_power", 0.0, 0.0, 1.0),
    ("ls_to_bls_period_harmonic_distance", 1.0, 0.0, 1.0),
    ("out_of_transit_rms_to_depth_ratio", 1.0, 0.0, 100.0),
    ("autocorrelation_at_period", 0.0, -1.0, 1.0),
    ("red_noise_beta_factor", 1.0, 0.5, 20.0),
    ("detection_snr", 5.0, 0.0, 10000.0),
    ("in_transit_flagged_fraction", 0.0, 0.0, 1.0),
    ("gap_proximity_fraction", 0.0, 0.0, 1.0),
    ("centroid_shift_sigma", 0.0, 0.0, 100.0),
    ("sap_to_pdcsap_depth_ratio", 1.0, 0.0, 10.0),
    ("crowdsap_value", 1.0, 0.0, 1.0),
]


def candidate_columns(fold: DataFrame) -> DataFrame:
    """Features that are the candidate's own: spectral power and harmonic distance, detection SNR, crowding."""
    return fold.groupBy(*KEY).agg(F.max("ls_power").alias("ls_max_power"), S.cycle_harmonic(F.max("ls_period"), F.max("period")).alias("ls_to_bls_period_harmonic_distance"), F.max("snr").alias("detection_snr"), F.max("crowding").alias("crowdsap_value"))


def enriched(fold: DataFrame) -> DataFrame:
    """Add what needs order or segments: the step from the cadence before, the distance to the segment's ends, the place out of transit."""
    w = Window.partitionBy(*KEY).orderBy("time_days", "cadence")
    segment = Window.partitionBy(*KEY, "segment_id")
    near = F.least(F.col("time_days") - F.min("time_days").over(segment), F.max("time_days").over(segment) - F.col("time_days"))
    place = F.count_if(~F.col("inside")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return fold.withColumns({"_step": F.col("time_days") - F.lag("time_days").over(w), "_near": near, "_place": place})


def _moments(centres: int) -> list:
    """Aggregates by target that later columns are made of: counts, sums and medians of the cadences in and out of transit."""
    x, t = F.col(X), F.col("time_days")
    inside, outside = F.col("inside"), F.col("outside")
    odd = F.pmod(F.col("cycle"), F.lit(2)) == 1
    before, after = F.when(inside & (F.col("fraction") < 0), x), F.when(inside & (F.col("fraction") >= 0), x)
    ones, twos, out = F.when(inside & odd, x), F.when(inside & ~odd, x), F.when(outside, x)
    far = outside & (F.abs("fraction") >= 0.35)
    wave = F.when(outside, F.cos(4 * pi * F.col("fraction")))
    half = F.col("phase") / (F.col("duration") / 2)
    bins = F.count_distinct(F.when(F.abs(half) <= 1, F.least(F.floor((half + 1) / 2 * 20), F.lit(19))))
    cols = [F.max(c).alias(c) for c in ("period", "epoch", "duration", "depth", "ingress", "delta_bic", "ls_power", "ls_period", "snr", "crowding")]
    cols += [F.min(t).alias("begin"), F.max(t).alias("end"), F.count("*").alias("n"), F.var_pop(x).alias("variance"), bins.alias("bins"), F.median(F.when(F.col("_step") > 0, F.col("_step"))).alias("dt")]
    for name, c in (("before", before), ("after", after), ("ones", ones), ("twos", twos), ("out", out)):
        cols += [F.count(c).alias(f"{name}_n"), F.avg(c).alias(f"{name}_avg"), F.var_pop(c).alias(f"{name}_var")]
    cols += [F.median(out).alias("out_median"), F.median(x).alias("median"), F.count_if(far).alias("far_n"), F.count_if(inside).alias("inside_n")]
    cols += [F.sum(wave * wave).alias("wave2"), F.sum(wave * x).alias("wave_x"), F.sum(wave).alias("wave")]
    for k in range(centres):
        spot = F.when(far & (F.abs(F.abs("fraction") - (0.35 + k * 0.15 / (centres - 1))) <= F.col("half")), x)
        cols += [F.count(spot).alias(f"far{k}_n"), F.avg(spot).alias(f"far{k}_avg")]
    cols += [F.count_if(inside & (F.col("quality") != 0)).alias("flagged_n"), F.count_if(inside & (F.col("_near") <= 1 / 24)).alias("near_n")]
    located = F.col("centroid_column").isNotNull() & F.col("centroid_row").isNotNull()
    for axis in ("column", "row"):
        for name, where in (("in", inside), ("off", ~inside)):
            c = F.when(located & where, F.col(f"centroid_{axis}"))
            cols += [F.avg(c).alias(f"{axis}_{name}"), F.try_divide(F.var_pop(c), F.count(c)).alias(f"{axis}_{name}_e"), F.count(c).alias(f"{axis}_{name}_n")]
    return cols + [F.median(F.when(inside, F.col("flux_delivered"))).alias("delivered"), F.median(F.when(inside, x)).alias("inside_median")]


def feature_vector(fold: DataFrame, centres: int = 9) -> DataFrame:
    """All 25 features by target: defaults for what isn't finite, each within its bounds.

    The fold is enriched once and kept, by target. One aggregation gives what needs no other result;
    deviations from its medians, block means, event depths and partners a period apart are four small
    aggregations of the same rows, which lie by target already, so that none of them shuffles.
    """
    wide = materialize(enriched(fold).repartition(*KEY))
    base = wide.groupBy(*KEY).agg(*_moments(centres))
    base = base.withColumn("size", F.greatest(F.lit(1), F.rint(F.greatest(F.lit(1.0), F.col("duration") / F.greatest(F.lit(1e-5), F.coalesce("dt", F.lit(2 / 1440)))))).cast("int"))
    base = materialize(base)
    x = F.col(X)
    rows = wide.select(*KEY, X, "inside", "outside", "_place").join(base.select(*KEY, "out_median", "median", "size"), KEY)
    spread = rows.groupBy(*KEY).agg(F.median(F.when(F.col("outside"), F.abs(x - F.col("out_median")))).alias("out_mad"), F.median(F.abs(x - F.col("median"))).alias("mad"))
    means = rows.filter("NOT inside").groupBy(*KEY, "size", F.floor(F.col("_place") / F.col("size")).alias("_b")).agg(F.avg(X).alias("m"), F.count("*").alias("k")).filter("k = size")
    blocks = means.groupBy(*KEY).agg(F.count("*").alias("blocks"), F.stddev_pop("m").alias("blocks_sigma"))
    depths = event_depths(wide).groupBy(*KEY).agg(F.collect_list("event_depth").alias("depths"))
    made = base.join(spread, KEY).join(blocks, KEY, "left").join(depths, KEY, "left").join(lag_autocorrelation(wide).drop("pairs"), KEY, "left")
    deep, scatter, events = F.greatest(F.col("depth"), F.lit(1e-5)), F.greatest(F.lit(1e-6), F.when(F.col("out_n") > 10, S.MAD_SCALE * F.col("out_mad")).otherwise(1e-3)), F.coalesce(F.size("depths"), F.lit(0))
    made = made.withColumns({"deep": deep, "scatter": scatter, "events": events})
    dip = lambda k: 1 - F.col(f"far{k}_avg")
    spots = F.array(*[F.struct(F.round(dip(k) / (F.col("scatter") / F.sqrt(f"far{k}_n")), 9).alias("snr"), F.lit(-k).alias("back"), dip(k).alias("dip"), F.col(f"far{k}_n").alias("n")) for k in range(centres)])
    made = made.withColumn("best", F.when(F.col("far_n") >= 5, F.array_max(F.filter(spots, lambda s: (s["n"] >= 3) & (s["snr"] > 0)))))
    c = F.col
    error = F.sqrt(F.greatest(F.lit(1e-12), c("ones_var") / c("ones_n") + c("twos_var") / c("twos_n")))
    expected = F.greatest(F.lit(1), F.floor((c("end") - c("epoch")) / c("period")) - F.ceil((c("begin") - c("epoch")) / c("period")) + 1)
    dx, dy = c("column_in") - c("column_off"), c("row_in") - c("row_off")
    shift_error = F.sqrt(F.greatest(F.lit(1e-12), c("column_in_e") + c("column_off_e") + c("row_in_e") + c("row_off_e")))
    white = F.greatest(F.lit(1e-6), S.MAD_SCALE * c("mad"))
    share = lambda n: F.coalesce(F.try_divide(c(n), c("inside_n")), F.lit(0.0))
    values = {
        "v_shape_ratio": c("ingress"),
        "duration_to_period_ratio": c("duration") / c("period"),
        "boxiness_index": 1 - c("ingress"),
        "asymmetry_score": F.when((c("before_n") >= 2) & (c("after_n") >= 2), F.abs(c("before_avg") - c("after_avg")) / c("deep")).otherwise(0.0),
        "batman_vs_trapezoid_delta_bic": F.coalesce(c("delta_bic"), F.lit(0.0)),
        "odd_even_depth_sigma": F.when((c("ones_n") >= 3) & (c("twos_n") >= 3), F.abs(c("ones_avg") - c("twos_avg")) / error).otherwise(0.0),
        "per_transit_depth_mad_ratio": F.when(c("events") > 0, F.when(c("events") >= 2, mad_of(c("depths")) / F.greatest(F.lit(1e-5), median_of(c("depths")))).otherwise(0.1)),
        "phase_coverage_fraction": c("bins") / 20,
        "in_transit_duty_cycle": F.least(c("events") / expected, F.lit(1.0)),
        "observed_event_count": F.when(c("events") > 0, c("events")),
        "max_secondary_snr": F.coalesce(c("best.snr"), F.lit(0.0)),
        "secondary_to_primary_depth_ratio": F.coalesce(F.greatest(c("best.dip"), F.lit(0.0)) / c("deep"), F.lit(0.0)),
        "secondary_phase_offset_from_half": F.coalesce(0.15 + c("best.back") * 0.15 / (centres - 1), F.lit(0.0)),
        "ellipsoidal_amplitude_ratio": F.when((c("out_n") >= 20) & (c("wave2") > 1e-6), F.greatest((c("out_avg") * c("wave") - c("wave_x")) / c("wave2"), F.lit(0.0)) / c("deep")).otherwise(0.0),
        "ls_max_power": c("ls_power"),
        "ls_to_bls_period_harmonic_distance": S.cycle_harmonic(c("ls_period"), c("period")),
        "out_of_transit_rms_to_depth_ratio": F.when(c("out_n") >= 10, F.sqrt("out_var") / c("deep")).otherwise(1.0),
        "autocorrelation_at_period": c("autocorrelation_at_period"),
        "red_noise_beta_factor": F.when(c("blocks") >= 5, c("blocks_sigma") / F.greatest(F.lit(1e-6), white / F.sqrt("size"))).when(c("blocks").isNotNull(), 1.0),
        "detection_snr": c("snr"),
        "in_transit_flagged_fraction": share("flagged_n"),
        "gap_proximity_fraction": share("near_n"),
        "centroid_shift_sigma": F.when((c("column_in_n") >= 3) & (c("column_off_n") >= 10), F.sqrt(dx * dx + dy * dy) / shift_error),
        "sap_to_pdcsap_depth_ratio": F.when(c("inside_n") >= 3, F.greatest(F.lit(0.0), 1 - c("delivered")) / F.greatest(F.lit(1e-5), 1 - c("inside_median"))).otherwise(1.0),
        "crowdsap_value": c("crowding"),
    }
    return made.select(*KEY, *[S.sanitized(values[n].cast("double"), d, lo, hi).alias(n) for n, d, lo, hi in FEATURES])


#: Words that a feature's name must not be, or hold between underscores.
LEAKING = {"tic", "tic_id", "target_id", "toi", "epic", "kic", "label", "ground_truth", "disposition", "class", "morphology_class", "split", "partition", "dataset_split", "source_group_id", "parent_source_group_id", "sector", "camera", "ccd", "ra", "dec", "magnitude", "tmag", "provenance", "filename", "source_uri", "source_path"}


def leaking_names(names: list[str]) -> list[str]:
    return [n for n in names if n.lower() in LEAKING or LEAKING & set(n.lower().split("_"))]
