"""Searches and fits that are done together equal those done one by one, and cost what they should."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import injection as J
from starfold.operators import kernels as K
from starfold.operators import search as X
from starfold.operators import studies as Y

#: As of the long curves: seven years, periods of weeks.
GRID = K.Grid(least=15.0, largest=65.0, least_duration=3.0, most_duration=7.0, durations=4)


def long_curve(seed: int, whole_days: bool, series: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    t = np.sort(rng.choice(2500, 250, replace=False)).astype(float) + (0 if whole_days else rng.uniform(0, 0.9, 250))
    x = 1 + rng.normal(0, 1e-3, (series, 250))
    for k in range(series):
        x[k] *= K.trapezoid(t, 4.0 + k, 21.3 + 9 * k, 0.01, 5.0, 0.2)
    return t, x


@pytest.mark.parametrize("whole_days,weighted", [(True, False), (False, True), (False, False)])
def test_sums_carried_on_from_period_to_period(whole_days, weighted):
    t, xs = long_curve(1, whole_days)
    error = np.random.default_rng(2).uniform(1, 2, len(t)) if weighted else None
    periods, widths = GRID.periods(float(np.ptp(t))), GRID.widths()
    got = K.drifting_powers(t, xs, error, periods, widths)
    want = np.array([K.box_powers(t, x, error, periods, widths)[0] for x in xs])
    assert len(periods) > 20000 and np.allclose(got, want, rtol=1e-10, atol=1e-18)


def test_a_cadence_costs_its_bins_and_not_all_periods():
    t, xs = long_curve(3, True, 1)
    periods = GRID.periods(float(np.ptp(t)))
    late = t[t - t[0] > 66] - t[0]
    cell, j, first, end, _ = K._stays(late, periods, 1.0)
    assert len(cell) < 0.15 * len(late) * len(periods) and (np.bincount(cell, end - first) == len(periods)).all()
    for i in (1, 700, len(periods) - 1):  # every cell is in one bin at every period
        here = (first <= i) & (end > i)
        assert np.array_equal(cell[here], np.arange(len(late))) and np.array_equal(j[here], np.floor(late % periods[i]))


def test_grids_that_do_not_drift_are_folded_whole():
    t, xs = long_curve(4, False)
    widths = GRID.widths()
    periods = GRID.periods(float(np.ptp(t)))
    assert K.drifting_powers(t, xs, None, periods[::-1], widths) is None
    assert K.drifting_powers(t, xs, None, np.linspace(15, 65, len(periods)), widths) is None
    assert K.drifting_powers(t, xs, None, periods[::200], widths) is None


@pytest.mark.parametrize("error", [None, 1])
def test_series_at_the_same_times_share_their_folds(error, monkeypatch):
    monkeypatch.setattr(K, "_SERIES_AT_ONCE", 9000)
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 12, 200))
    xs = np.stack([K.trapezoid(t, 0.5, p, 0.01, 0.2, 0.2) + rng.normal(0, 1e-3, 200) for p in (1.7, 2.6, 3.5, 4.4, 5.3)])
    error = error and rng.uniform(1, 2, 200)
    grid = K.Grid(1.0, 6.0, 0.1, 0.3, 3)
    periods = np.append(grid.periods(float(np.ptp(t))), [0.05, 0.2, 7.0])
    want = np.array([K.box_powers(t, x, error, periods, grid.widths())[0] for x in xs])
    assert np.allclose(K.shared_powers(t, xs, error, periods, grid.widths()), want, rtol=1e-10, atol=1e-18)
    alone = [K.find_candidates(t, x, error, 1, 6.0, grid) for x in xs]
    for (a, said), (b, status) in zip(K.first_candidates(t, xs, error, 6.0, grid), alone, strict=True):
        assert said == status == "searched" and len(a) == len(b) == 1
        assert all(a[0][k] == pytest.approx(v, rel=1e-9) if isinstance(v, float) else a[0][k] == v for k, v in b[0].items())
    assert K.first_candidates(t[:40], xs[:, :40], None, 6.0, grid) == [([], "too_few_cadences")] * 5


def test_trials_are_those_searched_alone(spark, monkeypatch):
    monkeypatch.setattr(Y, "_TRIALS_AT_ONCE", 7)
    trials = spark.range(40).select(F.col("id").alias("trial_id"), (1.7 + F.col("id") % 5 * 0.9).alias("period"), (0.002 + F.col("id") % 4 * 0.003).alias("depth"))
    got = {r["trial_id"]: r for r in Y.injection_trials(trials, 12.0, 30, 0.001).collect()}
    t, grid = np.linspace(0, 12.0, 360), K.Grid(1.0, 6.0, 0.1, 0.3, 3)
    for k in range(40):
        period, depth = 1.7 + k % 5 * 0.9, 0.002 + k % 4 * 0.003
        x = K.trapezoid(t, 0.3 * period, period, depth, 0.2, 0.2) + np.random.default_rng(k).normal(0, 0.001, 360)
        found, _ = K.find_candidates(t, x, None, 1, 6.0, grid)
        assert (got[k]["found"], got[k]["snr"]) == pytest.approx((found[0]["period"], found[0]["snr"])) if found else got[k]["status"] == "nothing"
    assert len(got) == 40


def test_trials_of_a_target_are_folded_together(spark):
    rng = np.random.default_rng(7)
    rows = [(target, i, float(a), float(1 + rng.normal() * 1e-3)) for target in (1, 2, 3) for i, a in enumerate(np.sort(rng.uniform(0, 2400, 200)))]
    curve = spark.createDataFrame(rows, "target_id long, cadence long, time_days double, flux_norm double").repartition(3)
    planned = J.trials(curve.select("target_id"), (21.0, 34.0), (0.02,), "s")
    got = {r["trial_id"]: r for r in J.searched_trials(curve, planned, 5.0, GRID, hours=30.0).collect()}
    rows = J.injected(curve, planned, 5.0).select(F.xxhash64("trial_id").alias("target_id"), "trial_id", "cadence", "time_days", "flux_norm")
    alone = {r["target_id"]: r for r in X.searched(rows, most=1, least_snr=6.0, grid=GRID).collect()}
    for key, trial in {(r[0], r[1]) for r in rows.select("target_id", "trial_id").distinct().collect()}:
        found = alone[key]["found"]
        assert got[trial]["detected"] == bool(found) and got[trial]["matched"] == (not trial.endswith("control"))
        assert not found or (got[trial]["period"], got[trial]["depth"], got[trial]["snr"]) == pytest.approx((found[0]["period"], found[0]["depth"], found[0]["snr"]), rel=1e-9)


def test_fits_together_take_the_steps_of_fits_alone():
    t, xs = long_curve(8, True, 1)
    error = np.full(len(t), 1e-3)
    many = np.stack([xs[0] + np.random.default_rng(k).normal(0, 2e-3, len(t)) for k in range(6)])
    together = K.fit_trapezoids(t, many, error, 4.0, 21.3, 0.01, 5.0)
    assert together == [K.fit_trapezoid(t, x, error, 4.0, 21.3, 0.01, 5.0) for x in many]
    fit = together[0]
    assert np.array_equal(K.block_bootstrap(t, xs[0], error, fit, 3, 5, 6), np.concatenate([K.block_bootstrap(t, xs[0], error, fit, 3, s) for s in (5, 6)]))


def test_a_step_calls_its_model_once_for_all_slopes():
    calls = []

    def model(q):
        calls.append(np.shape(q))
        return K._columns(q)[0] * np.linspace(0, 1, 50) + K._columns(q)[1]

    p, good = K.bounded_fit(model, np.array([0.5, 0.5]), np.array([0.0, 0.0]), np.array([9.0, 9.0]), 2 + 3 * np.linspace(0, 1, 50), np.ones(50), soft=False)
    assert good and p == pytest.approx([3.0, 2.0], abs=1e-4)
    assert sum(len(c) == 3 for c in calls) * 2 >= len(calls) / 5  # slopes of a step in one call, with tries beside


def test_the_physical_model_integrates_touching_disks_only(monkeypatch):
    asked = []
    plain = np.polynomial.legendre.leggauss
    monkeypatch.setattr(np.polynomial.legendre, "leggauss", lambda n: asked.append(n) or plain(n))
    K._nodes.cache_clear()
    z = np.linspace(0, 3, 301)
    flux = K.occulted_flux(z, 0.1, 0.3, 0.2)
    assert (flux[z >= 1.1] == 1).all() and (flux[z < 1.09] < 1).all()
    rows = K.occulted_flux(np.tile(z, 2), np.repeat([0.1, 0.2], 301), 0.3, 0.2)
    assert np.array_equal(rows[:301], flux) and np.array_equal(rows[301:], K.occulted_flux(z, 0.2, 0.3, 0.2))
    assert asked == [32]
    t = np.linspace(0, 9, 100)
    both = K.physical_model(t, *K._columns(np.array([[0.5, 3.0, 0.1, 9.0, 89.0], [0.6, 3.1, 0.12, 8.0, 88.0]])), 0.3, 0.2)
    assert np.array_equal(both[0], K.physical_model(t, 0.5, 3.0, 0.1, 9.0, 89.0, 0.3, 0.2)) and np.array_equal(both[1], K.physical_model(t, 0.6, 3.1, 0.12, 8.0, 88.0, 0.3, 0.2))
