"""Signals planted in a table's own curves, searched blindly, and matched with what was planted; a stopped study goes on where it ended.

A trial is a target and a signal, or a target alone (a control). Its series is the target's own cadences, whose
times, masks and other columns stay; only its flux is multiplied by the planted dip.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators import kernels as K
from starfold.operators import search as X
from starfold.session import materialize
from starfold.sources import publish

#: Bounds of the SNR's bands.
BANDS = (6.0, 10.0, 20.0, 50.0)


def trials(targets: DataFrame, periods: Sequence[float], depths: Sequence[float], seed: str, control: bool = True) -> DataFrame:
    """(trial_id, target_id, period, depth, share): every target with every period and depth, and without one.

    ``share``, from 0 to 1, places the first event within its period after the series' start; it is a hash of the
    seed and the trial, so a trial is the same whenever it is made. Signals are a short list, so targets multiply by its length.
    """
    pairs = [(f"p{i}_d{j}", float(p), float(d)) for i, p in enumerate(periods) for j, d in enumerate(depths)]
    signals = [F.struct(F.lit(n).alias("name"), F.lit(p).alias("period"), F.lit(d).alias("depth")) for n, p, d in pairs]
    if control:
        signals.append(F.struct(F.lit("control").alias("name"), F.lit(None).cast("double").alias("period"), F.lit(None).cast("double").alias("depth")))
    x = targets.select("target_id").distinct().select("target_id", F.explode(F.array(*signals)).alias("s"))
    trial = F.concat_ws("_", F.col("target_id").cast("string"), F.col("s.name"))
    share = S.hash_number(F.concat(F.lit(f"{seed}:"), trial)) / F.lit(float(1 << 32))
    return x.select(trial.alias("trial_id"), "target_id", "s.period", "s.depth", share.alias("share"))


def injected(curve: DataFrame, planned: DataFrame, duration: float, ingress: float = 0.2, exposure: float | None = None, flux: str = "flux_norm") -> DataFrame:
    """The rows of ``curve`` once for each trial of their target, with ``trial_id``, ``truth_epoch`` and the trial's flux.

    The dip is a trapezoid, averaged over ``exposure`` days if one is given. Rows without a finite time are kept as they are.
    """
    known = S.finite(F.col("time_days"))
    start = curve.filter(known).groupBy("target_id").agg(F.min("time_days").alias("_start"))
    planned = planned.join(start, "target_id").withColumn("truth_epoch", F.when(F.col("period").isNotNull(), F.col("_start") + F.col("share") * F.col("period")))
    x = curve.join(planned.select("trial_id", "target_id", "period", "depth", "truth_epoch"), "target_id")
    t, e, p = F.col("time_days"), F.col("truth_epoch"), F.col("period")
    dip = S.trapezoid(S.phase_days(t, e, p), F.col("depth"), duration, ingress) if exposure is None else S.trapezoid_exposed(t, e, p, F.col("depth"), duration, ingress, exposure)
    return x.withColumn(flux, F.col(flux) * F.when(p.isNotNull() & known, dip).otherwise(1.0)).drop("period", "depth")


def matches_truth(period: Column, epoch: Column, truth_period: Column, truth_epoch: Column, fraction: float = 0.01, hours: float = 3.0) -> Column:
    """Whether a found ephemeris is the planted one: period within a fraction, phase within hours. Harmonics don't count."""
    off = F.abs(S.phase_days(epoch, truth_epoch, truth_period))
    return F.coalesce((F.abs(period / truth_period - 1) <= fraction) & (off * 24 <= hours), F.lit(False))


OUTCOME = ("trial_id", "target_id", "kind", "truth_period", "truth_epoch", "truth_depth", "status", "period", "epoch", "depth", "snr", "detected", "harmonic", "matched")


def searched_trials(curve: DataFrame, planned: DataFrame, duration: float, grid: K.Grid, least_snr: float = 6.0, flux: str = "flux_norm", fraction: float = 0.01, hours: float = 3.0, **shape) -> DataFrame:
    """One row a trial, columns ``OUTCOME``: the best candidate of its series, or the reason why it wasn't searched."""
    key = F.xxhash64("trial_id")
    rows = injected(curve, planned, duration, flux=flux, **shape)
    truth = rows.groupBy("trial_id").agg(F.max("truth_epoch").alias("truth_epoch"))
    found = X.searched(rows.select(key.alias("target_id"), F.xxhash64("target_id").alias("kin"), "cadence", "time_days", F.col(flux)), flux, 1, least_snr, grid, kin="kin")
    best = found.select(F.col("target_id").alias("_key"), "status", F.get("found", F.lit(0)).alias("c"))
    x = planned.join(truth, "trial_id", "left").withColumn("_key", key).join(best, "_key", "left")
    p, tp = F.col("c.period"), F.col("period")
    harmonic = F.coalesce((F.abs(p / (tp * 0.5) - 1) <= fraction) | (F.abs(p / (tp * 2) - 1) <= fraction), F.lit(False))
    return x.select(
        "trial_id", "target_id", F.when(tp.isNull(), "control").otherwise("injection").alias("kind"), tp.alias("truth_period"), "truth_epoch", F.col("depth").alias("truth_depth"),
        F.coalesce("status", F.lit("no_cadences")).alias("status"), p.alias("period"), F.col("c.epoch").alias("epoch"), F.col("c.depth").alias("depth"), F.col("c.snr").alias("snr"),
        F.col("c").isNotNull().alias("detected"), harmonic.alias("harmonic"), matches_truth(p, F.col("c.epoch"), tp, F.col("truth_epoch"), fraction, hours).alias("matched"),
    )


def run_study(planned: DataFrame, folder: str, blocks: int, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(all results, how many trials were worked on now): ``work`` on the trials without a result, a block at a time.

    A block's results appear at once, by a rename, or not at all. Called again with the same folder, a study works on what is missing only:
    trials are anti-joined with the results there are, so more trials may be added; blocks without missing trials run no job.
    """
    spark = planned.sparkSession
    there = lambda: spark.read.parquet(f"{folder}/*/") if any_block() else None

    def any_block() -> bool:
        context, at = publish._files(spark, folder)
        return bool(context.util().exists(at) and any(s.isDirectory() and not s.getPath().getName().endswith(".part") for s in context.util().listStatus(at)))

    done = there()
    missing = planned if done is None else planned.join(done.select("trial_id"), "trial_id", "left_anti")
    missing = materialize(missing.withColumn("_block", F.pmod(F.xxhash64("trial_id"), F.lit(blocks)).cast("int")))
    counts = {r["_block"]: r["count"] for r in missing.groupBy("_block").count().collect()}  # at most ``blocks`` rows
    for block in sorted(counts):
        part = missing.filter(F.col("_block") == block).drop("_block")
        name = f"{folder}/block-{block}-{publish.digest(part.select('trial_id'))['sum'][:12]}"
        work(part).write.mode("overwrite").parquet(f"{name}.part")
        publish.rename(spark, f"{name}.part", name)
    return (there() if counts or done is not None else work(missing.drop("_block"))), sum(counts.values())


def recovery(outcomes: DataFrame, bands: Sequence[float] = BANDS) -> DataFrame:
    """(truth_period, truth_depth, band, trials, searched, detected, matched, harmonic): by signal and by the SNR's band; a band is null without a candidate.

    Rows of controls have null truths: what they detect is a false alarm, or a signal that the curve had.
    """
    band = F.when(F.col("snr").isNotNull(), F.concat_ws("", *[F.when(F.col("snr") >= b, F.lit(f">={b:g} ")) for b in bands]))
    return outcomes.groupBy("truth_period", "truth_depth", F.when(band.isNotNull(), F.regexp_extract(F.trim(band), r"(\S*)$", 1)).alias("band")).agg(
        F.count("*").alias("trials"), F.count_if(F.col("status") == "searched").alias("searched"), F.count_if("detected").alias("detected"), F.count_if("matched").alias("matched"), F.count_if("harmonic").alias("harmonic")
    )


def first_success(attempts: DataFrame, key: str, rank: str, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(the attempts that succeeded first, how many were worked on): rank by rank, and only for keys that no rank before has settled.

    ``work`` adds a boolean ``success`` to the attempts that it gets, all of one rank. There are as many rounds as ranks, and fewer if all keys
    succeed; what a round has worked out is written before the next begins.
    """
    ranks = [r[0] for r in attempts.select(rank).distinct().orderBy(rank).collect()]  # the number of rounds
    picks, worked = None, 0
    for r in ranks:
        waiting = attempts.filter(F.col(rank) == r)
        if picks is not None:
            waiting = waiting.join(picks.select(key), key, "left_anti")
        result = materialize(work(waiting))
        worked += result.count()
        won = result.filter(F.coalesce(F.col("success"), F.lit(False)))
        picks = won if picks is None else picks.unionByName(won)
    if picks is None:
        picks = work(attempts)
    return picks, worked
