"""Studies: joint fits over products, injections and recoveries, null trials, band power, exposure error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators import kernels as K
from starfold.operators.search import by_target, spread

JOINT = "target_id long, products int, epoch double, period double, duration double, ingress double, depths array<double>, status string"


def joint_fits(curve: DataFrame, candidates: DataFrame, flux: str = "flux_norm", least_points: int = 10) -> DataFrame:
    """One shape for all products of a target, a depth for each; targets seen at fewer than two events have the status no_event.

    ``curve`` has ``product_id``; ``candidates`` has epoch, period, depth and duration.
    """

    def work(p: pd.DataFrame) -> pd.DataFrame:
        f = p.iloc[0]
        out = {"target_id": f["target_id"], "products": p["product_id"].nunique(), "status": "no_event"}
        t = p["time_days"].to_numpy()
        inside = np.abs(K.phase(t, f["epoch"], f["period"])) <= f["duration"] / 2
        cycles = np.unique(np.rint((t[inside] - f["epoch"]) / f["period"]))
        if len(cycles) >= 2:
            parts = [g for _, g in p.groupby("product_id") if len(g) >= least_points]
            series = [(g["time_days"].to_numpy(), g[flux].to_numpy(), np.full(len(g), max(K.MAD * np.median(np.abs(g[flux] - g[flux].median())), 1e-6))) for g in parts]
            out["status"] = "insufficient_data"
            if series:
                q, good = K.fit_joint(series, f["epoch"], f["period"], f["depth"], f["duration"])
                k = len(series)
                out |= {"epoch": q[0], "period": q[1], "duration": q[2], "ingress": q[3], "depths": q[4 + k :].tolist(), "status": "fitted" if good else "not_converged"}
        return pd.DataFrame([out], columns=[c.split()[0] for c in JOINT.split(", ")])

    return by_target(curve.join(candidates, "target_id"), work, JOINT)


TRIAL = "trial_id long, period double, depth double, found double, snr double, status string, matched boolean"


#: Trials whose series, all at the same times, are searched together.
_TRIALS_AT_ONCE = 512


def injection_trials(trials: DataFrame, days: float, per_day: int, noise: float, least_snr: float = 6.0) -> DataFrame:
    """A noisy series with a planted dip for each trial (trial_id, period, depth), searched blindly; a failure is a row with its reason."""

    t, grid = np.linspace(0, days, int(days * per_day)), K.Grid(1.0, days / 2, 0.1, 0.3, 3)

    def run(parts):
        for part in parts:
            rows = []
            for lo in range(0, len(part), _TRIALS_AT_ONCE):
                some = part.iloc[lo : lo + _TRIALS_AT_ONCE]
                period, depth = (some[c].to_numpy(float)[:, None] for c in ("period", "depth"))
                xs = K.trapezoid(t, 0.3 * period, period, depth, 0.2, 0.2)
                xs += np.array([np.random.default_rng(int(k)).normal(0, noise, len(t)) for k in some["trial_id"]]).reshape(xs.shape)
                for r, (found, status) in zip(some.itertuples(), K.first_candidates(t, xs, None, least_snr, grid), strict=True):
                    if status != "searched":
                        rows.append((r.trial_id, r.period, r.depth, None, None, status, False))
                        continue
                    best = found[0] if found else None
                    near = bool(best and any(abs(best["period"] / (k * r.period) - 1) < 0.02 for k in (0.5, 1, 2)))
                    rows.append((r.trial_id, r.period, r.depth, best and best["period"], best and best["snr"], "detected" if best else "nothing", near))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRIAL.split(", ")])

    return spread(trials.select("trial_id", "period", "depth"), "trial_id").mapInPandas(run, TRIAL)


def autoregressive(innovations: np.ndarray, rho: float) -> np.ndarray:
    """A stationary first-order process from independent draws."""
    out = np.empty(len(innovations))
    last = innovations[0] / np.sqrt(max(1 - rho * rho, 1e-12)) if len(innovations) else 0.0
    for i, e in enumerate(innovations):
        last = last if i == 0 else rho * last + e
        out[i] = last
    return out


def band_power(curve: DataFrame, flux: str, bands: int = 8) -> DataFrame:
    """(target_id, quantiles, power): eight quantiles of the robustly scaled series, and log power of its spectrum in bands."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        x = p[flux].to_numpy()
        m = np.median(x)
        z = (x - m) / max(K.MAD * np.median(np.abs(x - m)), 1e-9)
        spectrum = np.abs(np.fft.rfft(z)) ** 2
        parts = np.array_split(spectrum[1:], bands)
        return pd.DataFrame([{"target_id": p["target_id"].iloc[0], "quantiles": np.quantile(z, np.linspace(0.05, 0.95, 8)).tolist(), "power": [float(np.log1p(b.mean())) if len(b) else 0.0 for b in parts]}])

    return by_target(curve, work, "target_id long, quantiles array<double>, power array<double>")


def exposure_errors(cases: DataFrame, samples: tuple[int, ...] = (3, 5, 11, 51)) -> DataFrame:
    """(case_id, samples, error_ppm): Simpson averages against the closed form's dense reference, for cases of (period, depth, duration, exposure)."""

    def run(parts):
        for part in parts:
            rows = []
            for r in part.itertuples():
                t = np.linspace(-r.duration, r.duration, 201)
                model = lambda u, r=r: K.trapezoid(u, 0.0, r.period, r.depth, r.duration, 0.2)
                dense = K.simpson_exposure(model, t, r.exposure, 2001)
                rows += [(r.case_id, n, float(np.abs(K.simpson_exposure(model, t, r.exposure, n) - dense).max() * 1e6)) for n in samples]
            yield pd.DataFrame(rows, columns=["case_id", "samples", "error_ppm"])

    return spread(cases, "case_id").mapInPandas(run, "case_id long, samples int, error_ppm double")


def dispatch_vetting(first: DataFrame, second: DataFrame) -> DataFrame:
    """The pixel assessment where there is one, else the one from centroids; with the tier it comes from."""
    x = first.select("target_id", F.col("assessment").alias("a1")).join(second.select("target_id", F.col("assessment").alias("a2")), "target_id", "left")
    return x.select("target_id", F.coalesce("a2", "a1").alias("assessment"), F.when(F.col("a2").isNotNull(), 2).otherwise(1).cast("bigint").alias("tier"))


def exposure_source(override, integration, frames):
    """(seconds, source) of an exposure: the user's, or integration times frames, or missing."""
    whole = integration * frames
    return (
        F.when(override.isNotNull(), F.struct(override.cast("double").alias("seconds"), F.lit("user_supplied").alias("source")))
        .when(whole > 0, F.struct(whole.cast("double").alias("seconds"), F.lit("frame_sum").alias("source")))
        .otherwise(F.struct(F.lit(None).cast("double").alias("seconds"), F.lit("missing").alias("source")))
    )


def seeds(key):
    return S.hash_number(F.concat(F.lit("trial:"), key.cast("string")))
