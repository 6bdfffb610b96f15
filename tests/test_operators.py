"""Light-curve operators on small inputs with known results."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators import cohort, kernels, metrics, prepare, search, transit
from starfold.plans.analyze import Settings, analyze
from starfold.plans.jobs import Jobs
from starfold.sources import catalogs, fits


def curve(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "target_id long, cadence long, time_days double, flux double, flux_error double, quality long")


def test_quality_reasons(spark):
    nan = float("nan")
    t, f = [1.0, nan, 3.0, 4.0, 5.0, 6.0, 7.0], [100.0, 100.0, -5.0, nan, 100.0, 100.0, 500.0]
    e, q = [1.0, 1.0, 1.0, 1.0, -1.0, 1.0, 1.0], [0, 0, 0, 0, 0, 0x0BEE, 0]
    rows = prepare.quality_flags(curve(spark, list(zip(t, f, e, q, strict=True))), sigma=3, error="flux_error").orderBy("cadence").collect()
    assert [r["exclusion_flags"] for r in rows][:6] == [0, 1, 2, 1, 4, 8]


def test_dips_survive_and_peaks_go(spark):
    x = 100 + np.random.default_rng(42).normal(0, 0.1, 200)
    x[50:55], x[80] = 95, 110
    rows = prepare.quality_flags(curve(spark, [(float(i), float(v), 1.0, 0) for i, v in enumerate(x)]), sigma=5).orderBy("cadence").collect()
    assert all(r["exclusion_flags"] == 0 for r in rows[50:55]) and rows[80]["exclusion_flags"] == 16


def test_mission_masks(spark):
    x = spark.createDataFrame([("Kepler", 0), ("Kepler", 128), ("Kepler", 256), ("TESS", 128)], "m string, q int")
    out = [r[0] for r in x.select((F.col("q").bitwiseAND(prepare.mission_mask(F.col("m"))) != 0).alias("x")).collect()]
    assert out == [False, False, True, True]
    with pytest.raises(Exception, match="no quality policy"):
        x.select(prepare.mission_mask(F.lit("other"))).collect()


def test_gap_and_normalization(spark):
    t = [*np.linspace(1, 5, 50), *np.linspace(6.5, 10.5, 50)]
    x = [1000.0] * 50 + [500.0] * 50
    p = prepare.prepared(curve(spark, [(float(a), b, 1.0, 0) for a, b in zip(t, x, strict=True)]), 0.25)
    g = p.groupBy("segment_id").agg(F.count("*").alias("n"), F.median("flux_norm").alias("m")).orderBy("segment_id").collect()
    assert [(r["segment_id"], r["n"], r["m"]) for r in g] == [(0, 50, 1.0), (1, 50, 1.0)]
    empty = prepare.prepared(curve(spark, [(1.0, float("nan"), 1.0, 0)]))
    assert empty.count() == 0


def test_phase_and_rounding(spark):
    x = spark.createDataFrame([(-0.3, 2.5), (1.0, 1.5), (9.9, 0.5)], "t double, h double")
    out = x.select(S.phase_fraction(F.col("t"), 0.0, 4.0), S.cycle_index(F.col("h"), 0.0, 1.0), S.aliases(F.lit(4.0))).collect()
    assert [round(r[0], 6) for r in out] == [-0.075, 0.25, 0.475] and [r[1] for r in out] == [2, 2, 0] and out[0][2] == [2.0, 8.0]


def test_exposure_average_matches_many_instants(spark):
    t = np.linspace(0, 10, 200)
    x = spark.createDataFrame([(float(v),) for v in t], "t double").select(S.trapezoid_exposed(F.col("t"), 1.0, 3.0, 0.01, 0.4, 0.5, 0.1)).collect()
    many = kernels.simpson_exposure(lambda u: kernels.trapezoid(u, 1.0, 3.0, 0.01, 0.4, 0.5), t, 0.1, 2001)
    assert np.allclose([r[0] for r in x], many, atol=1e-6)
    with pytest.raises(ValueError):
        kernels.simpson_exposure(np.cos, t, 0.1, 4)


def signal(days=25, noise=3e-4, seed=1):
    t = np.linspace(1, 1 + days, int(days * 72))
    x = 1 + np.random.default_rng(seed).normal(0, noise, len(t))
    for epoch, period, hours, ppm in ((1.5, 2.5, 2.5, 8000), (2.2, 6.0, 3.5, 6000)):
        x[np.abs(kernels.phase(t, epoch, period)) <= hours / 48] -= ppm * 1e-6
    return t, x


def test_two_signals_are_found():
    t, x = signal()
    found, status = kernels.find_candidates(t, x, None, 2, 6.0, kernels.Grid(1.0, 12.0, 0.05, 0.25, 8))
    assert status == "searched"
    assert sorted(round(c["period"], 1) for c in found) == [2.5, 6.0]
    assert all(c["events"] >= 2 and len(c["aliases"]) == 2 for c in found)


def test_sinusoid_and_false_alarm():
    t = np.sort(np.random.default_rng(0).uniform(0, 20, 400))
    x = 1 + 0.01 * np.sin(2 * np.pi * t / 3.3)
    f = np.arange(0.05, 2, 0.005)
    power = kernels.lomb_scargle(t, x, f)
    assert abs(1 / f[np.argmax(power)] - 3.3) < 0.1 and power.max() > 0.95
    assert kernels.false_alarm(power.max(), 400, 2, t) < 1e-6 and kernels.false_alarm(0.01, 400, 2, t) > 0.5


def test_shape_fit_recovers_truth():
    t = np.linspace(0, 27, 4000)
    x = kernels.trapezoid(t, 1.2, 3.4, 0.01, 0.2, 0.3) + np.random.default_rng(3).normal(0, 5e-4, len(t))
    fit = kernels.fit_trapezoid(t, x, np.full(len(t), 5e-4), 1.21, 3.401, 0.008, 0.17)
    assert fit.converged and abs(fit.period - 3.4) < 1e-3 and abs(fit.epoch - 1.2) < 0.01 and abs(fit.depth - 0.01) < 5e-4 and abs(fit.duration - 0.2) < 0.02 and 0.8 < fit.chi2 < 1.2
    drawn = kernels.block_bootstrap(t, x, np.full(len(t), 5e-4), fit, 12, 5)
    low, high = np.percentile(drawn[:, 2], [2.5, 97.5])
    assert len(drawn) >= 10 and low < 0.01 < high
    both, good = kernels.fit_joint([(t[:2000], x[:2000], np.full(2000, 5e-4)), (t[2000:], x[2000:], np.full(2000, 5e-4))], 1.21, 3.401, 0.008, 0.17)
    assert abs(both[1] - 3.4) < 2e-3 and abs(both[-1] - 0.01) < 1e-3


def test_physical_model_limits():
    z = np.array([0.0, 0.5, 2.0])
    dark = kernels.occulted_flux(z, 0.1, 0.0, 0.0)
    assert abs(dark[0] - 0.99) < 5e-4 and dark[2] == 1.0
    t = np.linspace(-0.3, 0.3, 301)
    x = kernels.physical_model(t, 0.0, 5.0, 0.1, 10.0, 89.5, 0.3, 0.2)
    found, bic, good = kernels.fit_physical(t, x, np.full(len(t), 1e-4), 0.001, 5.0, 0.012, 0.16, 0.3, 0.2)
    assert abs(found[2] - 0.1) < 0.01 and np.isfinite(bic)


def test_overlap_vectors():
    def run(spans):
        kept, winner = kernels.resolve_overlap(np.array([s for s, _ in spans], float), np.array([e for _, e in spans], float))
        return kept.tolist(), winner.tolist()

    assert run([(0, 1), (1, 2), (0.5, 1.5), (2, 3)]) == ([True, True, False, True], [-1, -1, 0, -1])
    assert run([(0, 2), (1, 1), (2, 2), (2, 2)]) == ([True, False, True, False], [-1, 0, -1, 2])


def test_downsampling_keeps_the_dip(spark):
    t, y = np.linspace(0, 100, 10_000), np.ones(10_000)
    y[5000:5010] = 0.95
    at = kernels.lttb(t, y, 1000)
    assert len(at) == 1000 and y[at].min() <= 0.96 and at[0] == 0 and at[-1] == 9999
    rows = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, y, strict=True))], "target_id long, cadence long, time_days double, flux double")
    out = search.minmax_downsample(rows, 1000)
    assert out.count() <= 1200 and out.agg(F.min("flux")).first()[0] <= 0.951


def feature_rows(spark, alternate=False):
    rng = np.random.default_rng(42)
    t = np.linspace(0, 20, 1000)
    depth = np.where(alternate & (np.rint((t - 1) / 4) % 2 == 1), 0.02, 0.01)
    x = 1 - depth * (1 - kernels.trapezoid(t, 1.0, 4.0, 1.0, 0.4, 0.15)) + rng.normal(0, 5e-4, 1000)
    rows = [(1, i, float(a), float(b), float(b), 0, 500 + rng.normal(0, 0.01), 500 + rng.normal(0, 0.01), 0) for i, (a, b) in enumerate(zip(t, x, strict=True))]
    prep = spark.createDataFrame(rows, "target_id long, cadence long, time_days double, flux_norm double, flux_delivered double, quality long, centroid_column double, centroid_row double, segment_id long")
    cand = spark.createDataFrame([(1, 1.0, 4.0, 0.4, 0.01, 0.15, 15.0, 25.0, 0.95, 10.0, 0.05)], "target_id long, epoch double, period double, duration double, depth double, ingress double, delta_bic double, snr double, crowding double, ls_period double, ls_power double")
    return transit.folded(prep, cand)


def test_feature_vector(spark):
    v = transit.feature_vector(feature_rows(spark)).first().asDict()
    assert len(v) == 26 and all(np.isfinite(x) for x in v.values())
    assert v["boxiness_index"] > 0.8 and v["v_shape_ratio"] < 0.2 and v["odd_even_depth_sigma"] < 3 and v["crowdsap_value"] == 0.95 and v["centroid_shift_sigma"] < 3
    assert transit.odd_even(feature_rows(spark, True)).first()["odd_even_depth_sigma"] > 5
    assert transit.leaking_names(["depth", "label_count", "TIC"]) == ["label_count", "TIC"]


def test_sanitizing(spark):
    x = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (5.0,), (-0.5,)], "x double").select(S.sanitized(F.col("x"), 0.3, 0.0, 1.0))
    assert [r[0] for r in x.collect()] == [0.3, 0.3, 0.3, 1.0, 0.0]


def test_ephemeris_cases(spark):
    x = spark.createDataFrame([(4.252, 100.51), (2.126, 100.50), (8.505, 100.50), (3.10, 100.5), (4.25, 102.625)], "p double, e double")
    m = cohort.match_ephemeris(F.col("p"), F.col("e"), F.lit(4.25), F.lit(100.5), F.lit(3.0))
    out = [(r["m"]["is_primary"], r["m"]["is_harmonic"]) for r in x.select(m.alias("m")).collect()]
    assert out == [(True, False), (False, True), (False, True), (False, False), (False, False)]


def test_metrics(spark):
    rows = [("t", [0.8, 0.1, 0.1], False), ("t", [0.1, 0.8, 0.1], False), ("e", [0.1, 0.8, 0.1], False), ("n", [0.1, 0.1, 0.8], False), ("t", [0.1, 0.1, 0.8], True)]
    x = metrics.predicted(spark.createDataFrame(rows, "truth string, probabilities array<double>, abstained boolean"), ["t", "e", "n"])
    by = {r["class"]: r for r in metrics.classification(x, ["t", "e", "n"]).collect()}
    assert by["t"]["precision"] == 1.0 and by["t"]["recall"] == pytest.approx(1 / 3)
    assert metrics.scores(x, ["t", "e", "n"]).first()["coverage"] == pytest.approx(0.8)
    perfect = metrics.predicted(spark.createDataFrame([("t", [1.0, 0.0])], "truth string, probabilities array<double>"), ["t", "e"])
    wrong = metrics.predicted(spark.createDataFrame([("e", [0.99, 0.01])], "truth string, probabilities array<double>"), ["t", "e"])
    assert metrics.expected_calibration_error(perfect).first()[0] == 0 and metrics.brier(perfect, ["t", "e"]).first()[0] == 0
    assert metrics.expected_calibration_error(wrong).first()[0] > 0.8


def test_fits_round_trip(spark, tmp_path):
    nan = float("nan")
    columns = {"TIME": ("D", [1, 2, nan]), "PDCSAP_FLUX": ("D", [100, 99, 98]), "PDCSAP_FLUX_ERR": ("D", [1, 1, 1]), "SAP_FLUX": ("D", [101, 100, 99]), "QUALITY": ("K", [0, 1, 0]), "CADENCENO": ("K", [10, 11, 12]), "MOM_CENTR1": ("D", [1.1, 1.2, 1.3]), "MOM_CENTR2": ("D", [2.1, 2.2, 2.3])}
    primary, header = {"TICID": 123456, "SECTOR": 42, "MISSION": "TESS", "CREATOR": "fixture"}, {"TIMESYS": "TDB", "BJDREFI": 2457000, "TIMEUNIT": "d"}
    data = fits.write_table({k: (a, np.array(v)) for k, (a, v) in columns.items()}, primary, header)
    (tmp_path / "a_lc.fits").write_bytes(data)
    rows = fits.read_fits(spark, str(tmp_path)).orderBy("cadence").collect()
    assert [r["flux"] for r in rows] == [100, 99, 98] and np.isnan(rows[2]["time_days"]) and rows[0]["sector"] == 42 and rows[0]["time_reference"] == 2457000.0
    only = {k: v for k, v in columns.items() if not k.startswith("PDC")}
    assert next(fits.read_curve(fits.write_table({k: (a, np.array(v)) for k, (a, v) in only.items()}, primary, header), "b"))[10] == "SAP_FLUX"
    with pytest.raises(ValueError, match="no TIME"):
        next(fits.read_curve(fits.write_table({"SAP_FLUX": ("D", np.ones(2))}, primary, header), "c"))
    fits.check_time_axis(header)
    for bad in ({"TIMESYS": "UTC"}, {"BJDREFI": 1}, {"TIMEUNIT": "s"}):
        with pytest.raises(ValueError):
            fits.check_time_axis(header | bad)
    cube = fits.write_table({"TIME": ("D", np.array([1.0, 2.0])), "FLUX": ("E", np.arange(12, dtype=float).reshape(2, 2, 3))}, primary, header)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x_tp.fits").write_bytes(cube)
    px = fits.read_pixels(spark, str(tmp_path / "p")).orderBy("frame", "row", "col").collect()
    assert [r["flux"] for r in px] == list(range(12)) and all(r["in_aperture"] for r in px)


def test_catalogs_and_bundles(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"entries": [{"product_id": "a", "x": 1}, {"product_id": "b", "x": 2}]}')
    rows = catalogs.read_entries(spark, str(tmp_path / "m.json"), "entries")
    assert catalogs.require(rows, ["product_id"], "product_id").count() == 2
    with pytest.raises(ValueError):
        catalogs.require(rows.union(rows), ["product_id"], "product_id")
    (tmp_path / "t.tsv").write_text("# note\nTIC\tPeriod\n---\t---\n12\t 3.5\n13\t4\n")
    assert [tuple(r) for r in catalogs.read_tab_catalog(spark, str(tmp_path / "t.tsv"), "TIC").collect()] == [("12", "3.5"), ("13", "4")]
    out = str(tmp_path / "bundle")
    table = spark.createDataFrame([("a1", 1)], "analysis_id string, v int")
    catalogs.write_bundle({"results": table}, out)
    assert catalogs.read_bundle(spark, out, ("results",))["results"].count() == 1
    recorded = catalogs.integrity(spark, out).cache()
    assert recorded.count() > 0 and catalogs.intact(spark, out, recorded)
    with pytest.raises(Exception, match="(?i)exist"):
        catalogs.write_bundle({"results": table}, out)


def test_jobs_move_once():
    jobs = Jobs(":memory:")
    jobs.create("j", ["a", "b", "c"])
    assert jobs.move_job("j", "pending", "running") and not jobs.move_job("j", "pending", "running")
    assert jobs.start("j:a") and jobs.finish("j:a") and not jobs.finish("j:a", "late")
    assert jobs.finish("j:b", "broken") and jobs.progress("j") == {"completed": 1, "failed": 1, "pending": 1}
    assert jobs.retry_failed("j") == 1 and jobs.start("j:c") and jobs.reset_interrupted("j") == 1
    assert len(jobs.page("j", 2, 1)) == 2
    with pytest.raises(ValueError):
        jobs.page("j", 0)


def test_analysis_end_to_end(spark):
    t, x = signal(12)
    rows = [(k, i, float(a), float(b) * 1000, 0) for k in (1, 2) for i, (a, b) in enumerate(zip(t, x, strict=True))] + [(3, i, float(i), 5.0, 0) for i in range(20)]
    c = spark.createDataFrame(rows, "target_id long, cadence long, time_days double, flux double, quality long")
    out = analyze(c, Settings(least_period=1.0, most_period=6.0, durations=5, window_days=1.5))
    assert {r["target_id"]: r["status"] for r in out["status"].collect()} == {1: "ok", 2: "ok", 3: "insufficient_data"}
    fits_ = {r["target_id"]: r for r in out["fits"].collect()}
    assert set(fits_) == {1, 2} and abs(fits_[1]["period"] - 2.5) < 0.02
    assert out["features"].count() == 2


def test_a_period_grid_over_budget_is_a_status():
    t = np.linspace(0, 30, 3000)
    x = 1 - 0.01 * (np.abs(kernels.phase(t, 1.0, 3.0)) < 0.1)
    grid = kernels.Grid(1.0, 10.0, 0.1, 0.3, 8)
    assert kernels.find_candidates(t, x, None, 1, 5.0, replace(grid, budget=50)) == ([], "grid_exceeds_budget")
    assert kernels.find_candidates(t[:40], x[:40], None, 1, 5.0, grid) == ([], "too_few_cadences")
    assert kernels.find_candidates(np.ones(99), np.ones(99), None, 1, 5.0, grid) == ([], "no_trial_periods")
    found, status = kernels.find_candidates(t, x, None, 1, 5.0, grid)
    assert status == "searched" and abs(found[0]["period"] - 3.0) < 0.05
    with pytest.raises(ValueError, match="exceed the budget"):
        kernels.period_grid(30, 1.0, 10.0, 0.1, budget=50)


def test_events_reach_intervals_however_wide_their_uncertainty(spark):
    events = spark.createDataFrame([(1, 0.0, 1.0, 0.1, 700.0, 0.0)], "id int, epoch double, period double, duration double, epoch_error double, period_error double")
    intervals = spark.createDataFrame([(1, 1000.5, 1000.6)], "id int, start double, stop double")
    assert cohort.events_in_intervals(events, intervals, "id").first()["cycle"] == 301


def test_medians_of_arrays(spark):
    row = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],), ([],)], "v array<double>").select(prepare.median_of(F.col("v")).alias("m"), prepare.mad_of(F.col("v")).alias("d")).collect()
    assert row[0]["m"] == 2.5 and abs(row[0]["d"] - 1.4826) < 1e-9 and row[1]["m"] is None


def test_trend_bridges_masked_stretches():
    t = np.arange(0.0, 10.0, 0.1)
    x = 1 + 0.01 * t
    hidden = (t > 4) & (t < 6)
    dip = np.where(hidden, x - 0.2, x)
    segment = np.zeros(len(t), int)
    _, own = kernels.detrend(t, dip, segment, 1.0, hidden)
    flat, trend = kernels.detrend(t, dip, segment, 1.0, hidden, interpolate=True)
    inside = (t > 4.6) & (t < 5.4)
    assert np.allclose(own[inside], dip[inside])  # without points the cadence itself
    assert np.allclose(trend[inside], x[inside], atol=5e-3) and (flat[inside] < 0.9).all()
    _, whole = kernels.detrend(t, dip, segment, 1.0, np.ones(len(t), bool), interpolate=True)
    assert np.allclose(whole, np.median(dip))
    assert np.allclose(kernels.interpolated_trend(t[:3], x[:3], np.ones(3, bool), 1.0), x[:3])


def test_second_pass_takes_each_targets_own_window(spark):
    rows = [(k, i, i * 0.1, 0, 1 + 0.05 * float(np.sin(np.pi * i * 0.1))) for k in (1, 2, 3) for i in range(100)]
    prep = spark.createDataFrame(rows, "target_id long, cadence long, time_days double, segment_id long, flux_norm double")
    found = spark.createDataFrame([(1, 50.0, 100.0, 0.1), (2, 50.0, 100.0, 1.5)], "target_id long, epoch double, period double, duration double")
    out = search.two_pass(prep, found, 0.5).toPandas()
    spread = out.groupby("target_id")["trend"].std()
    assert spread[2] < 0.8 * spread[1] and abs(spread[3] - spread[1]) < 1e-12
