"""The period search: folded in bulk, in blocks and by SQL, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import kernels as K
from starfold.operators import search as X


def series(n=600, days=25.0, seed=1, dips=((1.5, 2.5, 0.12, 0.008), (2.2, 6.1, 0.16, 0.006)), regular=False):
    rng = np.random.default_rng(seed)
    t = np.linspace(1, 1 + days, n) if regular else np.sort(rng.uniform(1, 1 + days, n))
    x = 1 + rng.normal(0, 3e-4, n)
    for epoch, period, duration, depth in dips:
        x[np.abs(K.phase(t, epoch, period)) <= duration / 2] -= depth
    return t, x


def plain_powers(t, x, error, periods, durations, oversample=3):
    """The definition, one box at a time: phase bins a third of the least duration, half-bin cells of time, wrapped runs."""
    w = np.ones(len(x)) if error is None else 1 / np.maximum(error, 1e-12) ** 2
    w = w / w.sum()
    wx = w * (x - (w * x).sum())
    step = durations.min() / oversample
    cells = {}
    for a, b, c in zip(t, w, wx, strict=True):
        cells.setdefault(int(np.floor((a - t[0]) / (step / 2))), []).append((a, b, c))
    cells = [(sum(b * a for a, b, _ in v) / sum(b for _, b, _ in v), sum(b for _, b, _ in v), sum(c for _, _, c in v)) for v in cells.values()]
    out = []
    for p in periods:
        n = max(1, int(np.ceil(p / step - 1e-9)))
        sw, sx = np.zeros(n), np.zeros(n)
        for a, b, c in cells:
            k = min(n - 1, int((((a - t[0]) / p) % 1) * p / step))
            sw[k] += b
            sx[k] += c
        best = (0.0, 0.0, 0.0, 0.0)
        for d in durations:
            m = max(1, int(np.rint(d / step)))
            for i in range(n if m < n else 0):
                own = [(i + j) % n for j in range(m)]
                a, b = sw[own].sum(), sx[own].sum()
                if b < 0 and a * (1 - a) > 1e-9 and b * b / (a * (1 - a)) > best[0] * (1 + 1e-12):
                    best = (b * b / (a * (1 - a)), -b / (a * (1 - a)), d, (t[0] + (i + m / 2) * step) % p)
        out.append(best)
    return np.array(out).T


@pytest.mark.parametrize("regular,weighted", [(True, False), (False, True)])
def test_powers_equal_plain_loops(regular, weighted):
    t, x = series(220, 12.0, 3, regular=regular)
    error = np.random.default_rng(4).uniform(2e-4, 6e-4, len(t)) if weighted else None
    durations = K.duration_grid(0.08, 0.3, 5, 1.0)
    periods = K.period_grid(np.ptp(t), 1.0, 6.0, 0.08, 2.0)
    power, depth, width, epoch = K.box_powers(t, x, error, periods, durations)
    want = plain_powers(t, x, error, periods, durations)
    assert len(periods) > 500 and np.allclose(power, want[0], rtol=1e-9, atol=1e-16)
    same = np.isclose(width, want[2]) & np.isclose(epoch, want[3])
    assert same.mean() > 0.98 and np.allclose(depth[same], want[1][same], rtol=1e-9)  # the rest are boxes of equal gain


def test_size_of_what_is_folded_at_once_does_not_matter(monkeypatch):
    t, x = series()
    durations, periods = K.duration_grid(0.05, 0.25, 6, 0.7), K.period_grid(np.ptp(t), 0.7, 9.0, 0.05, 5.0)
    whole = K.box_powers(t, x, None, periods, durations)
    monkeypatch.setattr(K, "_CELLS_AT_ONCE", 1)
    monkeypatch.setattr(K, "_BINS_AT_ONCE", 700)
    some = np.arange(0, len(periods), 7)
    small = K.box_powers(t, x, None, periods[some], durations)
    assert all(np.array_equal(a[some], b) for a, b in zip(whole, small, strict=True))


def test_rows_in_any_order_and_odd_periods():
    t, x = series(300, 10.0)
    order = np.random.default_rng(0).permutation(len(t))
    durations, periods = np.array([0.1, 0.2]), np.array([0.05, 0.1, 0.15, 0.2, 0.5, 2.5, 50.0])
    a, b = K.box_powers(t, x, None, periods, durations), K.box_powers(t[order], x[order], None, periods, durations)
    assert all(np.allclose(u, v) for u, v in zip(a, b, strict=True)) and np.isfinite(a[0]).all()
    flat = K.box_powers(t, np.ones(len(t)), None, periods, durations)
    assert flat[0].max() < 1e-25


def test_biweight_windows_in_bulk_equal_single_ones():
    rng = np.random.default_rng(5)
    t = np.sort(np.concatenate([rng.uniform(0, 4, 300), rng.uniform(9, 12, 200), [20.0]]))
    x, use = rng.normal(10, 1, len(t)), rng.random(len(t)) < 0.7
    x[50:90] = 7.0  # no scatter
    use[-1] = False  # nothing near the last
    got = K.biweight_trend(t, x, use, 0.8)
    for i in range(len(t)):
        near = x[use & (t >= t[i] - 0.4) & (t <= t[i] + 0.4)]
        if not len(near):
            assert got[i] == x[i]
            continue
        m = np.median(near)
        s = np.median(np.abs(near - m))
        u = (near - m) / (6 * s) if s >= 1e-12 else np.ones(len(near))
        w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
        assert np.isclose(got[i], (w * near).sum() / w.sum() if w.sum() > 0 else m, rtol=1e-12)
    some = np.array([3, 70, 400, 500])
    assert np.allclose(K.biweight_trend(t, x, use, 0.8, some)[some], got[some], rtol=1e-14)


GRID = K.Grid(0.8, 9.0, 0.06, 0.25, 6)


@pytest.fixture(scope="module")
def curve(spark):
    rows = []
    for target, (n, dips) in {1: (600, ((1.5, 2.5, 0.12, 0.008), (2.2, 6.1, 0.16, 0.006))), 2: (500, ((1.2, 3.3, 0.15, 0.01),)), 3: (400, ()), 4: (30, ())}.items():
        t, x = series(n, seed=target, dips=dips)
        rows += [(target, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))]
    rows += [(5, i, 7.0, 1.0) for i in range(80)]
    return spark.createDataFrame(rows, "target_id long, cadence long, time_days double, flux_norm double").repartition(5)


def rows_of(found):
    return {(r["target_id"], r["candidate"]): {k: r[k] for k in ("period", "epoch", "duration", "depth", "events", "snr", "sde", "aliases", "flags")} for r in found.collect()}


def same(a, b):
    assert set(a) == set(b)
    for key, row in a.items():
        for k, v in row.items():
            assert v == pytest.approx(b[key][k], rel=1e-9) if isinstance(v, float) else v == b[key][k], (key, k)


@pytest.mark.parametrize("block", [8192, 100])
def test_blocks_of_periods_find_what_one_search_finds(curve, monkeypatch, block):
    monkeypatch.setattr(X, "PERIOD_BLOCK", block)
    expected = {}
    for target in (1, 2, 3):
        part = curve.filter(F.col("target_id") == target).orderBy("time_days").toPandas()
        found, _ = K.find_candidates(part["time_days"].to_numpy(), part["flux_norm"].to_numpy(), None, 3, 7.0, GRID)
        expected |= {(target, c["candidate"]): {k: v for k, v in c.items() if k != "candidate"} for c in found}
    got = rows_of(X.candidates(curve, most=3, least_snr=7.0, grid=GRID))
    same(got, expected)
    assert abs(got[1, 1]["period"] - 2.5) < 0.02 and abs(got[1, 2]["period"] - 6.1) < 0.1 and abs(got[2, 1]["period"] - 3.3) < 0.02
    assert not any(t in (3, 4, 5) for t, _ in got)


def test_every_target_has_a_status(curve):
    status = {r["target_id"]: (r["status"], len(r["found"])) for r in X.searched(curve, most=1, least_snr=7.0, grid=GRID).collect()}
    assert status == {1: ("searched", 1), 2: ("searched", 1), 3: ("searched", 0), 4: ("too_few_cadences", 0), 5: ("no_trial_periods", 0)}
    tight = X.searched(curve, most=1, grid=K.Grid(0.8, 9.0, 0.06, 0.25, 6, budget=2300))
    assert {r["target_id"]: r["status"] for r in tight.collect()}[1] in ("searched", "grid_exceeds_budget")
    none = X.searched(curve, most=1, grid=K.Grid(0.8, 9.0, 0.06, 0.25, 6, budget=10))
    assert {r["target_id"]: r["status"] for r in none.collect()} == {1: "grid_exceeds_budget", 2: "grid_exceeds_budget", 3: "grid_exceeds_budget", 4: "too_few_cadences", 5: "no_trial_periods"}
    assert X.searched(curve.limit(0), grid=GRID).count() == 0


def test_the_default_grid_is_the_whole_one():
    grid = K.Grid()
    assert grid.count(27.0) == int((1 / 0.3 - 1 / 13.5) * 27.0**2 / (5 * 0.5 / 24)) + 1 == 22810 and grid.top(27.0) == 13.5 and len(grid.widths()) == 15
    assert K.Grid(largest=5.0).count(26.9986) == 21927
    p = grid.periods(27.0)
    assert p[0] == 0.3 and p[-1] <= 13.5 and np.allclose(np.diff(1 / p), -5.0 * 0.5 / 24 / 27.0**2)
    assert np.array_equal(grid.periods(27.0, slice(100, 200)), p[100:200])
