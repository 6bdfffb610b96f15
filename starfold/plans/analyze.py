"""The analysis of many targets as one job: prepare, detrend, search, fit, measure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.operators import prepare, search, transit
from starfold.operators.kernels import Grid


@dataclass(frozen=True)
class Settings:
    gap_days: float = 0.25
    sigma: float = 5.0
    quality_mask: int = 0x0BEE
    window_days: float = 0.75
    least_period: float = 0.3
    most_period: float | None = None  # half the series' length
    least_hours: float = 0.5
    most_hours: float = 12.0
    durations: int = 15
    frequency_factor: float = 5.0
    most_trials: int | None = None  # a target whose grid has more periods isn't searched, and its status says so
    candidates: int = 1
    least_snr: float = 6.0
    least_cadences: int = 200
    least_days: float = 2.0
    replicates: int = 40


def analyze(curve: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """``status``, ``prepared``, ``search``, ``candidates``, ``fits`` and ``features`` of all targets, lazily.

    Targets with too few cadences, or over too short a time, have the status insufficient_data and go no further;
    ``search`` has one row for each of the others, with what it found or why it wasn't searched.
    """
    s = settings
    flagged = prepare.quality_flags(curve, s.quality_mask, s.sigma)
    good = F.count_if(F.col("exclusion_flags") == 0)
    status = flagged.groupBy("target_id").agg(F.when((good < s.least_cadences) | (F.max("time_days") - F.min("time_days") < s.least_days), "insufficient_data").otherwise("ok").alias("status"))
    enough = flagged.join(status.filter("status = 'ok'").select("target_id"), "target_id", "left_semi")
    prep = prepare.normalize(prepare.segments(enough.filter("exclusion_flags = 0"), s.gap_days))
    flat = search.detrended(prep, s.window_days).select("target_id", "cadence", "flux_detrended")
    series = prep.join(flat, ["target_id", "cadence"]).withColumnsRenamed({"flux_norm": "flux_delivered", "flux_detrended": "flux_norm"})
    grid = Grid(s.least_period, s.most_period, s.least_hours / 24, s.most_hours / 24, s.durations, s.frequency_factor, s.most_trials)
    outcome = search.searched(series, "flux_norm", s.candidates, s.least_snr, grid)
    found = outcome.select("target_id", F.explode("found").alias("c")).select("target_id", "c.*")
    fits = search.refined(series, found)
    spectral = search.lomb_scargle_best(series, s.least_period).select("target_id", F.col("best_period").alias("ls_period"), F.col("peak_power").alias("ls_power"))
    snr = found.filter("candidate = 1").select("target_id", "snr")
    known = fits.filter("status <> 'failed'").select("target_id", "epoch", "period", "depth", "duration", "ingress", "delta_bic").join(snr, "target_id").join(spectral, "target_id", "left").withColumn("crowding", F.lit(None).cast("double"))
    for c in ("centroid_column", "centroid_row"):
        if c not in series.columns:
            series = series.withColumn(c, F.lit(None).cast("double"))
    return {"status": status, "prepared": series, "search": outcome, "candidates": found, "fits": fits, "features": transit.feature_vector(transit.folded(series, known))}
