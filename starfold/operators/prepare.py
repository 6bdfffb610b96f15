"""Quality flags, segments, normalization and scatter of light curves."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.session import materialize

ORDER = ("time_days", "cadence")
#: Fixed value: quality bits that exclude a cadence of the second mission.
KEPLER_MASK = 1 | 2 | 4 | 8 | 32 | 256 | 16384 | 65536 | 1048576


def quality_flags(curve: DataFrame, mask: int = S.QUALITY_MASK, sigma: float = 5.0, error: str | None = None) -> DataFrame:
    """Add ``exclusion_flags``: not finite 1, not positive 2, bad error 4, bad quality 8, positive outlier 16.

    Outliers lie above median + sigma * 1.4826 * MAD of their target's cadences without other
    flags, if there are more than ten of those. Dips are never outliers.
    """
    t, f = F.col("time_days"), F.col("flux")
    bit = lambda cond, value: F.when(F.coalesce(cond, F.lit(False)), value).otherwise(0)
    flags = bit(~S.finite(t) | ~S.finite(f), S.NOT_FINITE) + bit(S.finite(f) & (f <= 0), S.NOT_POSITIVE) + bit(F.col("quality").bitwiseAND(mask) != 0, S.BAD_QUALITY)
    if error:
        flags += bit(~S.finite(F.col(error)) | (F.col(error) <= 0), S.BAD_ERROR)
    base = curve.withColumn("exclusion_flags", flags)
    valid = F.when(F.col("exclusion_flags") == 0, f)
    w = Window.partitionBy("target_id")
    limits = base.withColumns({"_n": F.count(valid).over(w), "_median": F.median(valid).over(w)})
    limits = limits.withColumn("_scale", S.MAD_SCALE * F.median(F.abs(valid - F.col("_median"))).over(w))
    high = (F.col("_n") > 10) & (F.col("_scale") > 0) & (F.col("exclusion_flags") == 0) & (f > F.col("_median") + sigma * F.col("_scale"))
    return limits.withColumn("exclusion_flags", F.col("exclusion_flags") + bit(high, S.OUTLIER)).drop("_n", "_median", "_scale")


def mission_mask(mission):
    """The quality mask of each mission that is known; others are an error."""
    return F.when(mission == "TESS", S.QUALITY_MASK).when(mission == "Kepler", KEPLER_MASK).otherwise(F.raise_error(F.concat(F.lit("no quality policy for "), mission)))


def segments(curve: DataFrame, gap_days: float = 0.25) -> DataFrame:
    """Add ``segment_id``, from 0: a new segment begins where the step is longer than ``gap_days``."""
    w = Window.partitionBy("target_id").orderBy(*ORDER)
    step = F.col("time_days") - F.lag("time_days").over(w)
    marked = curve.withColumn("_new", F.when(step > gap_days, 1).otherwise(0))
    return marked.withColumn("segment_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def normalize(curve: DataFrame) -> DataFrame:
    """Add ``flux_norm``: flux by its segment's median, where that is positive."""
    m = F.median("flux").over(Window.partitionBy("target_id", "segment_id"))
    return curve.withColumn("_m", m).withColumn("flux_norm", F.when(F.col("_m") > 0, F.col("flux") / F.col("_m")).otherwise(F.col("flux"))).drop("_m")


def prepared(curve: DataFrame, gap_days: float = 0.25, **quality) -> DataFrame:
    """Valid cadences with their segment and normalized flux."""
    return normalize(segments(quality_flags(curve, **quality).filter("exclusion_flags = 0"), gap_days))


def mad_by(df: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """1.4826 * MAD of ``value`` by keys."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_d", F.abs(F.col(value) - F.median(value).over(w))).groupBy(*keys).agg((S.MAD_SCALE * F.median("_d")).alias(out))


def ptp_scatter(prep: DataFrame) -> DataFrame:
    """``scatter_ptp_ppm`` by target, from differences within segments; 0 if there are none."""
    w = Window.partitionBy("target_id", "segment_id").orderBy(*ORDER)
    steps = prep.select("target_id", (F.col("flux_norm") - F.lag("flux_norm").over(w)).alias("step"))
    found = mad_by(steps, "step", "mad", "target_id")
    return found.select("target_id", F.coalesce(F.col("mad") / sqrt(2) * 1e6, F.lit(0.0)).alias("scatter_ptp_ppm"))


def cdpp(prep: DataFrame, hours: float, out: str, scatter: DataFrame | None = None) -> DataFrame:
    """``out`` by target: scatter of means of whole blocks of ``hours``; with under three blocks, from the point-to-point scatter."""
    w = Window.partitionBy("target_id").orderBy(*ORDER)
    steps = prep.select("target_id", (F.col("time_days") - F.lag("time_days").over(w)).alias("dt")).groupBy("target_id").agg(F.median("dt").alias("dt"))
    size = F.greatest(F.lit(1), F.coalesce(F.rint(F.lit(hours / 24) / F.when(F.col("dt") > 0, F.col("dt"))), F.lit(1)).cast("int"))
    sizes = steps.select("target_id", size.alias("block"))
    row = F.row_number().over(Window.partitionBy("target_id", "segment_id").orderBy(*ORDER)) - 1
    blocks = prep.withColumn("_row", row).join(sizes, "target_id").groupBy("target_id", "segment_id", F.floor(F.col("_row") / F.col("block")).alias("_b"), "block")
    means = blocks.agg(F.avg("flux_norm").alias("mean"), F.count("*").alias("n")).filter("n = block")
    found = mad_by(means, "mean", "mad", "target_id").join(means.groupBy("target_id").agg(F.count("*").alias("blocks")), "target_id")
    both = sizes.join(found, "target_id", "left").join(scatter if scatter is not None else ptp_scatter(prep), "target_id")
    return both.select("target_id", F.when(F.col("blocks") >= 3, F.col("mad") * 1e6).otherwise(F.col("scatter_ptp_ppm") / F.sqrt("block")).alias(out))


def median_of(values):
    """Median of an array; null for none."""
    ordered, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def mad_of(values):
    """1.4826 * MAD of an array of numbers."""
    middle = median_of(values)
    return S.MAD_SCALE * median_of(F.transform(values, lambda v: F.abs(v - middle)))


def summary(curve: DataFrame, gap_days: float = 0.25, hours: tuple[float, ...] = (1, 2, 6), **quality) -> DataFrame:
    """One row a target: cadences, valid ones, excluded ones, segments and scatter.

    Steps and places are derived once, and kept; two aggregations by target read them: one of
    medians, and one of block means for all ``hours`` together with the deviations from the medians.
    """
    flagged = quality_flags(curve, **quality).withColumn("_initial", F.count("*").over(Window.partitionBy("target_id")))
    prep = normalize(segments(flagged.filter("exclusion_flags = 0"), gap_days))
    by_time = Window.partitionBy("target_id").orderBy(*ORDER)
    in_segment = Window.partitionBy("target_id", "segment_id").orderBy(*ORDER)
    wide = materialize(prep.select("target_id", "segment_id", "flux_norm", "_initial", (F.col("time_days") - F.lag("time_days").over(by_time)).alias("dt"), (F.col("flux_norm") - F.lag("flux_norm").over(in_segment)).alias("step"), (F.row_number().over(in_segment) - 1).alias("_row")))
    first = wide.groupBy("target_id").agg(F.max("_initial").alias("initial"), F.count("*").alias("valid"), (F.max("_initial") - F.count("*")).alias("excluded"), F.count_distinct("segment_id").alias("segment_count"), F.median("step").alias("_m"), F.median("dt").alias("_dt"))
    steps = wide.filter("step is not null").select("target_id", "step").join(first.select("target_id", "_m"), "target_id").groupBy("target_id").agg((S.MAD_SCALE * F.median(F.abs(F.col("step") - F.col("_m")))).alias("mad"))
    size = lambda h: F.greatest(F.lit(1), F.coalesce(F.rint(F.lit(h / 24) / F.when(F.col("_dt") > 0, F.col("_dt"))), F.lit(1)).cast("int"))
    each = wide.join(first.select("target_id", "_dt"), "target_id").withColumn("_h", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), size(h).alias("size")) for k, h in enumerate(hours)])))
    means = each.groupBy("target_id", "_h", "segment_id", F.floor(F.col("_row") / F.col("_h.size")).alias("_b")).agg(F.avg("flux_norm").alias("mean"), F.count("*").alias("n")).filter("n = _h.size")
    kept = means.groupBy("target_id").agg(*[F.collect_list(F.when(F.col("_h.k") == k, F.col("mean"))).alias(f"_means{k}") for k in range(len(hours))])
    both = first.join(steps, "target_id", "left").join(kept, "target_id", "left").withColumn("scatter_ptp_ppm", F.coalesce(F.col("mad") / sqrt(2) * 1e6, F.lit(0.0)))
    cdpps = [F.when(F.size(f"_means{k}") >= 3, mad_of(F.col(f"_means{k}")) * 1e6).otherwise(F.col("scatter_ptp_ppm") / F.sqrt(size(h))).alias(f"cdpp_{h:g}h") for k, h in enumerate(hours)]
    return both.select("target_id", "initial", "valid", "excluded", "segment_count", "scatter_ptp_ppm", *cdpps)
