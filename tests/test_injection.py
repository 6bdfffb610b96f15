"""Signals planted in given curves: what is planted, what is found, and studies that go on where they ended."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import injection as J
from starfold.operators import kernels as K

GRID = K.Grid(1.0, 6.0, 0.08, 0.3, 5)


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(5)
    rows = []
    for target in (1, 2):
        t = np.sort(rng.uniform(3, 28, 700))
        rows += [(target, i, float(a), float(1 + rng.normal() * 5e-4), i % 9) for i, a in enumerate(t)]
    rows += [(1, 900, None, 1.0, 0), (3, 0, 1.0, 1.0, 0)]
    return spark.createDataFrame(rows, "target_id long, cadence long, time_days double, flux_norm double, quality int").cache()


def planned(curve, periods=(2.5, 4.0), depths=(0.01,), seed="s"):
    return J.trials(curve.select("target_id"), periods, depths, seed)


def test_what_is_planted(curve):
    rows = J.injected(curve, planned(curve), 0.2, 0.3).collect()
    by_trial = {}
    for r in rows:
        by_trial.setdefault(r["trial_id"], []).append(r)
    assert set(by_trial) == {f"{t}_{s}" for t in (1, 2, 3) for s in ("p0_d0", "p1_d0", "control")}
    own = {(r["target_id"], r["cadence"]): r for r in curve.collect()}
    for trial, mine in by_trial.items():
        target = int(trial.split("_")[0])
        assert len(mine) == sum(t == target for t, _ in own)
        start = min(r["time_days"] for (t, _), r in own.items() if t == target and r["time_days"] is not None)
        period = {"p0": 2.5, "p1": 4.0}.get(trial.split("_")[1])
        share = int(hashlib.sha256(f"s:{trial}".encode()).hexdigest()[:8], 16) / 2**32
        for r in mine:
            was = own[target, r["cadence"]]
            assert (r["time_days"], r["quality"]) == (was["time_days"], was["quality"])
            if period is None or r["time_days"] is None:
                assert r["flux_norm"] == was["flux_norm"]
                continue
            epoch = start + share * period
            assert r["truth_epoch"] == pytest.approx(epoch)
            off = abs((r["time_days"] - epoch + period / 2) % period - period / 2)
            assert r["flux_norm"] == pytest.approx(was["flux_norm"] * (1 - 0.01 * np.clip((0.1 - off) / (0.1 * 0.3), 0, 1)), rel=1e-12)


def test_truth_has_no_harmonics(spark):
    x = spark.createDataFrame([(2.5, 1.0), (5.0, 1.0), (1.25, 1.0), (2.52, 1.0), (2.51, 1.1), (2.51, 1.2), (2.5, 3.51), (None, None)], "p double, e double")
    got = [r[0] for r in x.select(J.matches_truth(F.col("p"), F.col("e"), F.lit(2.5), F.lit(1.0))).collect()]
    assert got == [True, False, False, True, True, False, True, False]


def test_planted_signals_are_recovered(curve):
    out = {r["trial_id"]: r for r in J.searched_trials(curve, planned(curve), 0.2, GRID, least_snr=7.0).collect()}
    assert len(out) == 9
    for trial, r in out.items():
        if trial.startswith("3"):
            assert r["status"] == "too_few_cadences" and not r["detected"]
        elif trial.endswith("control"):
            assert r["kind"] == "control" and not r["detected"] and not r["matched"] and r["truth_period"] is None
        else:
            assert r["matched"] and not r["harmonic"] and r["snr"] > 10 and r["depth"] == pytest.approx(0.01, abs=0.004), r


def test_recovery_by_band(spark):
    rows = [(2.5, 0.01, 7.0, "searched", True, True, False), (2.5, 0.01, 12.0, "searched", True, False, True), (2.5, 0.01, 60.0, "searched", True, True, False), (2.5, 0.01, None, "searched", False, False, False), (None, None, None, "too_few_cadences", False, False, False), (2.5, 0.01, 3.0, "searched", True, False, False)]
    x = spark.createDataFrame(rows, "truth_period double, truth_depth double, snr double, status string, detected boolean, matched boolean, harmonic boolean")
    got = {(r["truth_period"], r["band"]): (r["trials"], r["searched"], r["detected"], r["matched"], r["harmonic"]) for r in J.recovery(x).collect()}
    assert got == {(2.5, ">=6"): (1, 1, 1, 1, 0), (2.5, ">=10"): (1, 1, 1, 0, 1), (2.5, ">=50"): (1, 1, 1, 1, 0), (2.5, None): (1, 1, 0, 0, 0), (None, None): (1, 0, 0, 0, 0), (2.5, ""): (1, 1, 1, 0, 0)}


def test_a_study_goes_on_where_it_ended(spark, curve, tmp_path):
    folder, calls = str(tmp_path / "study"), []

    def work(part):
        calls.append(part.count())
        if len(calls) == 2 and not (tmp_path / "again").exists():
            (tmp_path / "again").touch()
            return part.withColumn("x", F.assert_true(F.lit(False), F.lit("the cluster is gone")).cast("string"))
        return part.withColumn("x", F.concat("trial_id", F.lit("!")))

    trials = planned(curve)
    with pytest.raises(Exception, match="gone"):
        J.run_study(trials, folder, 3, work)
    first = calls[0]
    calls.clear()
    results, now = J.run_study(trials, folder, 3, work)
    assert now == 9 - first == sum(calls) and results.count() == 9
    calls.clear()
    results, now = J.run_study(trials, folder, 3, work)
    assert now == 0 and calls == [] and results.count() == 9
    results, now = J.run_study(planned(curve, (2.5, 4.0, 5.0)), folder, 3, work)
    assert now == 3 and results.count() == 12 and {r["x"] for r in results.collect()} == {r["trial_id"] + "!" for r in results.collect()}
    none, now = J.run_study(trials.limit(0), str(tmp_path / "none"), 3, work)
    assert now == 0 and none.count() == 0


def test_first_success_in_order(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(r), bool(rng.random() < 0.4) if rng.random() < 0.9 else None) for k in range(40) for r in range(1, 5) if rng.random() < 0.8]
    attempts = spark.createDataFrame(rows, "source long, rank int, works boolean")
    seen = []

    def work(part):
        seen.append(part.count())
        return part.withColumn("success", F.col("works"))

    picks, worked = J.first_success(attempts, "source", "rank", work)
    expected, tried = {}, 0
    for k in range(40):
        for _, r, ok in sorted(x for x in [(a, b, c) for a, b, c in rows if a == k]):
            tried += 1
            if ok:
                expected[k] = r
                break
    assert {p["source"]: p["rank"] for p in picks.collect()} == expected and picks.count() == len(expected)
    assert worked == tried == sum(seen) < len(rows)
    assert J.first_success(attempts.limit(0), "source", "rank", work)[0].count() == 0
