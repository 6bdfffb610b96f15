"""Period search, detrending, fits and combination of curves, one grouped task a target."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from starfold.functions import series as S
from starfold.operators import kernels as K


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by key to as many tasks as the session shuffles to: kernels cost time, not bytes, by which tasks would be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_target(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a kernel on each target's rows, in time order. A target is one star's series, so its size is bounded by the survey."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return work(part.sort_values(["time_days", "cadence"], kind="stable").reset_index(drop=True))

    return spread(df, "target_id").groupBy("target_id").applyInPandas(run, schema)


def detrended(prep: DataFrame, window: float | str, masked: str | None = None, interpolate: bool = False) -> DataFrame:
    """(target_id, cadence, time_days, segment_id, flux_detrended, trend): biweight trend within segments.

    ``window`` is in days, or names the column that has each target's. Masked cadences don't shape the trend; ``interpolate`` takes
    it from both sides where a window isn't whole or has masked cadences only, instead of from the cadence itself.
    """

    def work(p: pd.DataFrame) -> pd.DataFrame:
        mask = p[masked].to_numpy(bool) if masked else None
        days = float(p[window].iloc[0]) if isinstance(window, str) else window
        flux, trend = K.detrend(p["time_days"].to_numpy(), p["flux_norm"].to_numpy(), p["segment_id"].to_numpy(), days, mask, interpolate)
        return p[["target_id", "cadence", "time_days", "segment_id"]].assign(flux_detrended=flux, trend=trend)

    return by_target(prep, work, "target_id long, cadence long, time_days double, segment_id long, flux_detrended double, trend double")


def two_pass(prep: DataFrame, candidates: DataFrame, window: float, interpolate: bool = True) -> DataFrame:
    """A second trend that the candidates' events don't pull down: for each target three of its own longest durations wide, half a day at least.

    Targets without candidates keep ``window`` and the first pass's trend.
    """
    from starfold.operators.transit import transit_mask

    own = candidates.groupBy("target_id").agg(F.greatest(3 * F.max("duration"), F.lit(0.5)).alias("window_days"))
    x = transit_mask(prep, candidates).join(own, "target_id", "left").withColumn("window_days", F.coalesce("window_days", F.lit(float(window))))
    return detrended(x, "window_days", "masked", interpolate)


def lomb_scargle_best(prep: DataFrame, least_period: float, samples: int = 5) -> DataFrame:
    """(target_id, best_period, peak_power, false_alarm) over frequencies up to 1 / least_period."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        t, x = p["time_days"].to_numpy(), p["flux_norm"].to_numpy()
        span = np.ptp(t)
        row = {"target_id": p["target_id"].iloc[0], "best_period": None, "peak_power": None, "false_alarm": None}
        if len(t) >= 5 and span > 0:
            f = np.arange(1 / span, 1 / least_period, 1 / (samples * span))
            if len(f):
                power = K.lomb_scargle(t, x, f)
                k = int(np.argmax(power))
                row |= {"best_period": 1 / f[k], "peak_power": power[k], "false_alarm": K.false_alarm(power[k], len(t), f[-1], t)}
        return pd.DataFrame([row])

    return by_target(prep, work, "target_id long, best_period double, peak_power double, false_alarm double")


CANDIDATE = "target_id long, candidate int, period double, epoch double, duration double, depth double, events int, snr double, sde double, aliases array<double>, flags array<string>"
_FOUND = CANDIDATE.split(", ", 1)[1].replace(", ", ",").replace(" ", ":")
_SERIES = "target_id long, kin long, n long, t binary, x binary, error binary, hidden binary"
_STATE = f"{_SERIES}, status string, open boolean, found array<struct<{_FOUND}>>"
_PEAK = ("power", "period", "epoch", "duration", "depth", "n", "total", "squares")

#: Series at the same times that are folded together.
_KIN_AT_ONCE = 32

#: Trial periods that a task searches for one target: a series goes once to each block of its grid.
PERIOD_BLOCK = 8192


def searched(prep: DataFrame, flux: str = "flux_norm", most: int = 2, least_snr: float = 6.0, grid: K.Grid = K.Grid(), error: str | None = None, fewest: int = 50, kin: str | None = None) -> DataFrame:
    """(target_id, status, found): every target once, with its candidates, or why it wasn't searched: ``too_few_cadences``,
    ``no_trial_periods`` or ``grid_exceeds_budget``; one target's fault leaves the others alone. Cadences without a finite time and flux take no part.

    A series is packed into one row. In each of ``most`` rounds it goes once to every block of PERIOD_BLOCK trial periods, which are tasks
    of their own; their peaks meet again by target, where the best becomes a candidate and its events are hidden. ``kin`` names a column, a long that
    targets with the same times have in common: they are dealt to the same tasks, and folded together.
    """
    size = PERIOD_BLOCK
    whole, partial = (to_arrow_schema(_parse_datatype_string(s)) for s in (_STATE, _PARTIAL))

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        target = p["target_id"].iloc[0]
        p = p[np.isfinite(p["time_days"].to_numpy(float)) & np.isfinite(p[flux].to_numpy(float))]
        part = lambda c: p[c].to_numpy(float).tobytes()
        baseline = float(np.ptp(p["time_days"])) if len(p) else 0.0
        fault = grid.fault(len(p), baseline, fewest)
        row = {"target_id": target, "kin": p[kin or "target_id"].iloc[0] if len(p) else target, "n": 0 if fault else grid.count(baseline), "t": part("time_days"), "x": part(flux), "error": part(error) if error else None, "hidden": np.zeros(len(p), bool).tobytes(), "status": fault or "searched", "open": not fault, "found": []}
        return pd.DataFrame([row])

    def series(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        number = lambda c: np.frombuffer(row[c], float)
        return number("t"), number("x"), number("error") if row["error"] is not None else None

    def peaks(stream):
        widths = grid.widths()
        for batch in stream:
            for (*_, block, is_open, _, _), rows in groupby(batch.to_pylist(), lambda r: (r["kin"], r["block"], r["open"], r["t"], r["error"])):
                while some := list(islice(rows, _KIN_AT_ONCE)):
                    found = [K.Peak() for _ in some]
                    if is_open:
                        t, _, e = series(some[0])
                        at = slice(block * size, (block + 1) * size)
                        found = K.Peak.of_all(t, np.stack([series(r)[1] for r in some]), e, grid.periods(float(np.ptp(t)), at), widths)
                    if block:  # the first block carries the series on
                        some = [r | {c: None for c in ("t", "x", "error", "hidden", "found", "status")} for r in some]
                    yield pa.RecordBatch.from_pylist([r | {f"p_{k}": getattr(peak, k) for k in _PEAK} for r, peak in zip(some, found, strict=True)], schema=partial)

    def measure(number: int):
        def run(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["block"])
            state = {k: v for k, v in rows[0].items() if k != "block" and not k.startswith("p_")}
            if state["open"]:
                peak = K.Peak()
                for r in rows:
                    peak = peak.joined(K.Peak(*(r[f"p_{k}"] for k in _PEAK)))
                t, x, _ = series(state)
                found, x, hidden = K.next_candidate(t, x, np.frombuffer(state["hidden"], bool), peak, number, least_snr)
                state |= {"x": x.tobytes(), "hidden": hidden.tobytes(), "found": state["found"] + ([found] if found else []), "open": found is not None and K.enough_open(hidden)}
            return pa.Table.from_pylist([state], schema=whole)

        return run

    parts = int(prep.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = by_target(prep, pack, _STATE)
    for number in range(1, most + 1):
        blocks = F.explode(F.sequence(F.lit(0), F.when(F.col("open"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).otherwise(0)))
        dealt = state.withColumn("block", blocks).repartition(parts, "kin", "block").sortWithinPartitions("kin", "block", "open")
        state = spread(dealt.mapInArrow(peaks, _PARTIAL), "target_id").groupBy("target_id").applyInArrow(measure(number), _STATE)
    return state.select("target_id", "status", "found")


_PARTIAL = f"{_STATE}, block int, " + ", ".join(f"p_{k} {'long' if k == 'n' else 'double'}" for k in _PEAK)


def candidates(prep: DataFrame, flux: str = "flux_norm", most: int = 2, least_snr: float = 6.0, grid: K.Grid = K.Grid(), error: str | None = None, fewest: int = 50) -> DataFrame:
    """Up to ``most`` periodic dips of each target, a row each; ``searched`` says what became of the others."""
    found = searched(prep, flux, most, least_snr, grid, error, fewest)
    return found.select("target_id", F.explode("found").alias("c")).select("target_id", "c.*")


def _noise(x: np.ndarray) -> np.ndarray:
    return np.full(len(x), max(K.MAD * np.median(np.abs(x - np.median(x))), 1e-6))


FIT = "target_id long, period double, epoch double, depth double, duration double, ingress double, chi2 double, bic double, delta_bic double, status string"


def refined(curve: DataFrame, found: DataFrame, flux: str = "flux_norm", physical_snr: float = 7.0) -> DataFrame:
    """Trapezoid fits, and where the SNR is enough and the shape not a V, the physical model's BIC less the trapezoid's.

    A fit that doesn't settle is a row with its status, never a lost target.
    """

    def work(p: pd.DataFrame) -> pd.DataFrame:
        first = p.iloc[0]
        t, x = p["time_days"].to_numpy(), p[flux].to_numpy()
        error = _noise(x)
        out = {"target_id": first["target_id"], "status": "failed"}
        try:
            fit = K.fit_trapezoid(t, x, error, first["epoch"], first["period"], first["depth"], first["duration"])
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame([out], columns=[c.split()[0] for c in FIT.split(", ")])
        out |= {"period": fit.period, "epoch": fit.epoch, "depth": fit.depth, "duration": fit.duration, "ingress": fit.ingress, "chi2": fit.chi2, "bic": fit.bic, "delta_bic": None, "status": "fitted" if fit.converged else "not_converged"}
        if first["snr"] >= physical_snr and fit.ingress < 0.8:
            other = K.fit_physical(t, x, error, fit.epoch, fit.period, fit.depth, fit.duration)
            out["delta_bic"] = other[1] - fit.bic if other else None
        return pd.DataFrame([out], columns=[c.split()[0] for c in FIT.split(", ")])

    best = found.filter("candidate = 1").select("target_id", "period", "epoch", "depth", "duration", "snr")
    return by_target(curve.join(best, "target_id"), work, FIT)


def bootstrap(curve: DataFrame, fits: DataFrame, flux: str = "flux_norm", replicates: int = 40, tasks: int = 4) -> DataFrame:
    """(target_id, parameter, n_success, low68, high68, low95, high95) by block bootstrap; null bounds under ten refits.

    Replicates of a target are drawn in ``tasks`` groups, seeded by the hash of target and group, and refitted together.
    """
    names = ["epoch", "period", "depth", "duration"]

    def work(p: pd.DataFrame) -> pd.DataFrame:
        f = p.iloc[0]
        fit = K.ShapeFit(f["f_epoch"], f["f_period"], f["f_depth"], f["f_duration"], f["f_ingress"], 0.0, 0.0, True)
        x = p[flux].to_numpy()
        drawn = K.block_bootstrap(p["time_days"].to_numpy(), x, _noise(x), fit, replicates // tasks, *(int(f[f"seed{k}"]) for k in range(1, tasks + 1)))
        return pd.DataFrame([(f["target_id"], n, v) for row in drawn for n, v in zip(names, row, strict=True)], columns=["target_id", "parameter", "value"])

    f = fits.filter("status <> 'failed'").select("target_id", *[F.col(c).alias(f"f_{c}") for c in (*names, "ingress")])
    seed = lambda k: S.hash_number(F.concat_ws("_", F.col("target_id").cast("string"), F.lit(str(k))))
    rows = curve.join(f.withColumns({f"seed{k}": seed(k) for k in range(1, tasks + 1)}), "target_id")
    values = by_target(rows, work, "target_id long, parameter string, value double")
    q = F.percentile("value", F.array(*[F.lit(v) for v in (0.16, 0.84, 0.025, 0.975)]))
    g = values.groupBy("target_id", "parameter").agg(F.count("*").alias("n_success"), q.alias("q"))
    bound = lambda k: F.when(F.col("n_success") >= 10, F.col("q")[k])
    return g.select("target_id", "parameter", "n_success", bound(0).alias("low68"), bound(1).alias("high68"), bound(2).alias("low95"), bound(3).alias("high95"))


def permutation_test(prep: DataFrame, periods: int, bins: int, permutations: int) -> DataFrame:
    """(target_id, observed, exceedances, p_value) of the best box power when fluxes are shuffled; assumes that they are independent."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        t, x = p["time_days"].to_numpy(), p["flux_norm"].to_numpy()
        grid = 1 / np.linspace(1 / 10, 1 / 2, periods)
        rng = np.random.default_rng(int(p["target_id"].iloc[0]))
        best = [K.box_least_squares(t, v, None, grid, np.array([2.0 / bins * 4]), 2).power.max() for v in [x, *[rng.permutation(x) for _ in range(permutations)]]]
        more = int((np.array(best[1:]) >= best[0] * (1 - 32 * np.finfo(float).eps)).sum())
        return pd.DataFrame([{"target_id": p["target_id"].iloc[0], "observed": best[0], "exceedances": more, "p_value": (more + 1) / (permutations + 1)}])

    return by_target(prep, work, "target_id long, observed double, exceedances int, p_value double")


# --- relational forms -------------------------------------------------------------------


def relational_bls(prep: DataFrame, periods: int, least: float, most: float, bins: int = 20, widest: int = 3) -> DataFrame:
    """Best (period, width, phase bin) by box likelihood, all as joins and sums: one row a target.

    Cadences are summed by phase bin before bins multiply to the boxes that hold them.
    """
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda k: F.struct(k.alias("k"), (1 / (1 / least + k * ((1 / most - 1 / least) / (periods - 1)))).alias("p"))))
    w = Window.partitionBy("target_id")
    x = prep.select("target_id", "time_days", F.avg("flux_norm").over(w).alias("_m"), "flux_norm").withColumn("g", grid)
    at = F.floor(F.pmod(F.col("time_days"), F.col("g.p")) / F.col("g.p") * bins).cast("int")
    sums = x.groupBy("target_id", F.col("g.k").alias("k"), at.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("flux_norm") - F.col("_m")).alias("s"))
    box = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(widest)), lambda m: F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct(m.alias("m"), F.pmod(F.col("bin") - j, F.lit(bins)).alias("b"))))))
    boxes = sums.withColumn("x", box).groupBy("target_id", "k", "x.m", "x.b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = prep.groupBy("target_id").agg(F.count("*").alias("total"))
    power = F.when((F.col("s") < 0) & (F.col("n") < F.col("total")), F.col("s") * F.col("s") / (F.col("n") * (1 - F.col("n") / F.col("total")))).otherwise(0.0)
    best = boxes.join(total, "target_id").withColumn("power", F.round(power, 6)).groupBy("target_id").agg(F.max_by(F.struct("k", "m", "b", "power"), F.struct("power", -F.col("k"), -F.col("m"), -F.col("b"))).alias("x"))
    return best.select("target_id", F.col("x.k").cast("bigint").alias("period_index"), F.col("x.m").cast("bigint").alias("width"), F.col("x.b").cast("bigint").alias("bin"), "x.power")


def relational_lomb_scargle(prep: DataFrame, frequencies: int, step: float) -> DataFrame:
    """(target_id, k, power) of the floating-mean periodogram at k * step cycles a day: sums of products, then a formula."""
    n = F.count("*").over(Window.partitionBy("target_id"))
    x = prep.select("target_id", (F.col("flux_norm") - F.avg("flux_norm").over(Window.partitionBy("target_id"))).alias("y"), "time_days", n.alias("n"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(frequencies)))).withColumn("a", 2 * np.pi * step * F.col("k") * F.col("time_days"))
    c, s, y = F.cos("a"), F.sin("a"), F.col("y")
    m = x.groupBy("target_id", "k").agg(*[F.avg(e).alias(name) for name, e in (("c", c), ("s", s), ("yc", y * c), ("ys", y * s), ("cc", c * c), ("ss", s * s), ("cs", c * s), ("yy", y * y))])
    col = F.col
    cc, ss, cs = col("cc") - col("c") * col("c"), col("ss") - col("s") * col("s"), col("cs") - col("c") * col("s")
    d = cc * ss - cs * cs
    power = F.try_divide(ss * col("yc") * col("yc") + cc * col("ys") * col("ys") - 2 * cs * col("yc") * col("ys"), d * col("yy"))
    return m.select("target_id", col("k").cast("bigint").alias("k"), F.when((d > 1e-9) & (col("yy") > 0), S.clip(power, 0, 1)).otherwise(0.0).alias("power"))


def candidate_sequence(fold: DataFrame, bins: int = 256, reach: float = 5.0) -> DataFrame:
    """(target_id, bin, flux, occupancy): medians of scaled, clipped flux within ``reach`` durations, zero in empty bins; cadences by the fullest bin's."""
    r = F.col("phase") / F.col("duration")
    w = Window.partitionBy("target_id")
    x = fold.withColumn("_r", r).filter(F.abs("_r") <= reach)
    x = x.withColumns({"bin": F.least(F.floor((F.col("_r") + reach) / (2 * reach) * bins), F.lit(bins - 1)).cast("bigint"), "_m": F.median("flux_norm").over(w)})
    x = x.withColumn("_s", S.MAD_SCALE * F.median(F.abs(F.col("flux_norm") - F.col("_m"))).over(w))
    scaled = S.clip((F.col("flux_norm") - F.col("_m")) / F.when(F.col("_s") > 2.220446049250313e-16, F.col("_s")).otherwise(1.0), -10, 10)
    g = x.groupBy("target_id", "bin").agg(F.median(scaled).alias("flux"), F.count("*").alias("n"))
    full = g.select("target_id").distinct().withColumn("bin", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: k.cast("bigint"))))
    out = full.join(g, ["target_id", "bin"], "left").fillna(0.0, ["flux"]).fillna(0, ["n"])
    return out.select("target_id", "bin", "flux", (F.col("n") / F.max("n").over(w)).alias("occupancy"))


def minmax_downsample(curve: DataFrame, points: int, value: str = "flux") -> DataFrame:
    """The least and greatest cadence of each bucket of ceil(n / (points / 2)) rows in time order; all, if there are no more than ``points``."""
    w = Window.partitionBy("target_id")
    size = F.ceil(F.count("*").over(w) / (points // 2))
    x = curve.withColumns({"_b": F.floor((F.row_number().over(w.orderBy("time_days", "cadence")) - 1) / size), "_n": F.count("*").over(w)})
    keep = F.struct("time_days", "cadence", value)
    both = x.filter(F.col("_n") > points).groupBy("target_id", "_b").agg(F.min_by(keep, F.struct(value, "time_days", "cadence")).alias("lo"), F.max_by(keep, F.struct(F.col(value), -F.col("time_days"), -F.col("cadence"))).alias("hi"))
    few = x.filter(F.col("_n") <= points).select("target_id", "time_days", "cadence", value)
    return both.select("target_id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")).select("target_id", "x.*").union(few)


def lttb_downsample(curve: DataFrame, points: int, value: str = "flux") -> DataFrame:
    def work(p: pd.DataFrame) -> pd.DataFrame:
        return p.iloc[K.lttb(p["time_days"].to_numpy(), p[value].to_numpy(), points)][["target_id", "cadence", "time_days", value]]

    return by_target(curve, work, f"target_id long, cadence long, time_days double, {value} double")


# --- combination of products ------------------------------------------------------------


def provider_rank(provider):
    return F.when(provider == "SPOC", 0).when(provider == "TESS-SPOC", 1).otherwise(2)


def cadence_width(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Lower median of the positive steps between distinct times, of products with three of them at least."""
    t = curve.select(*keys, "time_days").distinct()
    step = F.col("time_days") - F.lag("time_days").over(Window.partitionBy(*keys).orderBy("time_days"))
    g = t.withColumn("_d", step).groupBy(*keys).agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _d)").alias("w"))
    return g.select(*keys, F.when(F.col("n") >= 3, F.col("w")).alias("width_days"))


def resolve_overlaps(curve: DataFrame, width: float) -> DataFrame:
    """(target_id, product_id, cadence, kept, winner): cadences by preference of product; a loser names the product that has its time."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["rank", "product_id", "time_days", "cadence"], kind="stable").reset_index(drop=True)
        t = p["time_days"].to_numpy()
        kept, winner = K.resolve_overlap(t - width / 2, t + width / 2)
        name = p["product_id"].to_numpy()
        return p[["target_id", "product_id", "cadence"]].assign(kept=kept, winner=[name[w] if w >= 0 else None for w in winner])

    ranked = curve.withColumn("rank", provider_rank(F.col("product_id")))
    return ranked.groupBy("target_id").applyInPandas(work, "target_id long, product_id string, cadence long, kept boolean, winner string")


def stitch(curve: DataFrame) -> DataFrame:
    """One series a target from all of its products, in time order, with the place of each cadence."""
    return curve.withColumn("place", F.row_number().over(Window.partitionBy("target_id").orderBy("time_days", "product_id", "cadence")).cast("bigint") - 1)


# --- pixels -----------------------------------------------------------------------------


def pixel_rows(frames: DataFrame, side: int) -> DataFrame:
    """Frames (target_id, frame, in_event, stamp) as rows of pixels (row, col, flux)."""
    x = frames.select("target_id", "frame", "in_event", F.posexplode("stamp").alias("_i", "flux"))
    return x.select("target_id", "frame", "in_event", F.floor(F.col("_i") / side).cast("bigint").alias("row"), (F.col("_i") % side).cast("bigint").alias("col"), F.col("flux").cast("double").alias("flux"))


def difference_image(pixels: DataFrame) -> DataFrame:
    """Mean of each pixel out of events less that in them."""
    g = pixels.groupBy("target_id", "row", "col").agg(F.avg(F.when(F.col("in_event"), F.col("flux"))).alias("inside"), F.avg(F.when(~F.col("in_event"), F.col("flux"))).alias("outside"))
    return g.select("target_id", "row", "col", (F.col("outside") - F.col("inside")).alias("difference"))


def difference_offset(pixels: DataFrame, side: int) -> DataFrame:
    """Distance of the centroid of the positive difference from the middle of the stamp, in pixels."""
    d = difference_image(pixels).withColumn("w", F.greatest("difference", F.lit(0.0)))
    g = d.groupBy("target_id").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("col")).alias("x"), F.sum(F.col("w") * F.col("row")).alias("y"))
    dx, dy = F.try_divide("x", "total") - side / 2, F.try_divide("y", "total") - side / 2
    return g.select("target_id", "total", F.sqrt(dx * dx + dy * dy).alias("offset_pixels"))


def aperture_growth(pixels: DataFrame, side: int, small: float = 1.2, large: float = 2.8) -> DataFrame:
    """Depth in a large aperture by that in a small one; null without a depth or a positive level."""
    r = F.sqrt(F.pow(F.col("col") - side / 2, 2) + F.pow(F.col("row") - side / 2, 2))
    f = pixels.withColumn("_r", r).groupBy("target_id", "frame", "in_event").agg(F.sum(F.when(F.col("_r") <= small, F.col("flux")).otherwise(0.0)).alias("core"), F.sum(F.when(F.col("_r") <= large, F.col("flux")).otherwise(0.0)).alias("wide"))
    m = f.groupBy("target_id").agg(*[F.median(F.when(F.col("in_event") == inside, F.col(c))).alias(f"{c}_{tag}") for c in ("core", "wide") for tag, inside in (("in", True), ("out", False))], F.count_if("in_event").alias("frames_in"), F.count_if(~F.col("in_event")).alias("frames_out"))
    depth = lambda c: F.greatest(F.lit(0.0), 1 - F.try_divide(f"{c}_in", f"{c}_out"))
    level = (F.col("core_out") > 0) & (F.col("wide_out") > 0)
    x = m.withColumns({"core_depth": F.when(level, depth("core")).otherwise(0.0), "wide_depth": F.when(level, depth("wide")).otherwise(0.0)})
    return x.select("target_id", "frames_in", "frames_out", "core_depth", "wide_depth", F.when(level & (F.col("core_depth") > 1e-5), F.try_divide("wide_depth", "core_depth")).alias("growth"))


def vet_tier2(pixels: DataFrame, side: int, sigma_pixel: float) -> DataFrame:
    """Assessment from pixels: displaced by half a pixel and three sigma, or growing with the aperture and displaced by 0.3, is a suspected blend.

    Under three frames in events or ten out of them there is none, and tier 1 stands.
    """
    x = difference_offset(pixels, side).join(aperture_growth(pixels, side), "target_id")
    off = F.when(F.col("total") > 0, F.col("offset_pixels"))
    sigma = off / sigma_pixel
    blend = ((off >= 0.5) & (sigma >= 3)) | ((F.col("growth") >= 1.4) & (off >= 0.3))
    known = F.when(off.isNull(), "unresolved").when(F.coalesce(blend, F.lit(False)), "blend_suspected").when((off < 0.5) & (sigma < 3), "target_consistent").otherwise("unresolved")
    return x.select("target_id", F.when((F.col("frames_in") < 3) | (F.col("frames_out") < 10), F.lit(None).cast("string")).otherwise(known).alias("assessment"), off.alias("offset_pixels"), "growth")
