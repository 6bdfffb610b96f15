"""Table functions called from SQL, against the DataFrame forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.functions import tables
from starfold.operators import kernels as K
from starfold.operators import search as X


@pytest.fixture(scope="module")
def sql(spark):
    rng = np.random.default_rng(2)
    rows = []
    for target, (period, depth) in {1: (2.5, 0.01), 2: (3.3, 0.012), 3: (2.0, 0.0)}.items():
        t = np.sort(rng.uniform(0, 20, 500))
        x = 1 + rng.normal(0, 3e-4, 500) - depth * (np.abs(K.phase(t, 1.0, period)) <= 0.06)
        rows += [(target, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))]
    rows += [(4, 0, 1.0, 1.0), (5, 0, None, None)]
    curve = spark.createDataFrame(rows, "target_id long, cadence long, time_days double, flux_norm double").repartition(4)
    curve.createOrReplaceTempView("curve_of_functions")
    odd = curve.select(F.concat(F.lit("star "), "target_id").alias("Star"), (F.col("time_days") + 0).alias("t"), F.col("flux_norm").alias("f"), "cadence")
    odd.unionByName(odd.filter("cadence < 3").withColumn("f", F.lit(float("nan")))).createOrReplaceTempView("odd_table")
    tables.register(spark)
    return spark.sql


GRID = "least => 0.8D, largest => 9.0D, least_duration => 0.06D, most_duration => 0.2D, durations => 5"
CALL = f"box_search(TABLE(curve_of_functions) PARTITION BY target_id ORDER BY time_days, key => 'target_id', flux => 'flux_norm', least_snr => 7.0D, {GRID})"


def test_search_equals_the_dataframe_form(spark, sql):
    rows = sql(f"SELECT * FROM {CALL}").collect()
    whole = X.candidates(spark.table("curve_of_functions").dropna(), most=2, least_snr=7.0, grid=K.Grid(0.8, 9.0, 0.06, 0.2, 5))
    want = {(r["target_id"], r["candidate"]): r for r in whole.collect()}
    got = {(r["target_id"], r["candidate"]): r for r in rows if r["candidate"] is not None}
    assert set(got) == set(want) and {t for t, _ in got} == {1, 2}
    for key, r in want.items():
        for c in ("period", "epoch", "duration", "depth", "snr"):
            assert got[key][c] == pytest.approx(r[c], rel=1e-12)
        assert got[key]["flags"] == r["flags"] and got[key]["aliases"] == r["aliases"] and got[key]["events"] == r["events"]
    assert {(r["target_id"], r["status"]) for r in rows if r["candidate"] is None} == {(3, "searched"), (4, "too_few_cadences"), (5, "too_few_cadences")}


def test_any_table_and_key_type(sql):
    rows = sql(f"SELECT Star, candidate, period FROM box_search(TABLE(odd_table) PARTITION BY Star, key => 'star', time => 'T', flux => 'f', most => 1, {GRID}) WHERE candidate = 1").collect()
    assert sorted((r["Star"], round(r["period"], 1)) for r in rows if r["Star"] != "star 3") == [("star 1", 2.5), ("star 2", 3.3)]
    joined = sql(f"SELECT count(*) AS n FROM (SELECT * FROM {CALL}) c JOIN curve_of_functions x USING (target_id) WHERE c.candidate = 1").first()["n"]
    assert joined == 1000


def test_trend_equals_the_kernel(spark, sql):
    rows = sql("SELECT * FROM sliding_trend(TABLE(curve_of_functions) PARTITION BY target_id ORDER BY time_days, key => 'target_id', flux => 'flux_norm', id => 'cadence', window => 1.5D, gap => 0.2D)").collect()
    assert len(rows) == 1501
    got = {(r["target_id"], r["row"]): (r["trend"], r["segment"]) for r in rows}
    for target in (1, 2, 3):
        part = spark.table("curve_of_functions").filter(f"target_id = {target}").toPandas().sort_values("time_days")
        t, x = part["time_days"].to_numpy(), part["flux_norm"].to_numpy()
        segment = np.concatenate([[0], np.cumsum(np.diff(t) > 0.2)])
        _, trend = K.detrend(t, x, segment, 1.5)
        for c, v, s in zip(part["cadence"], trend, segment, strict=True):
            assert got[target, c][0] == pytest.approx(v, rel=1e-12) and got[target, c][1] == s


def test_fit_from_sql(sql):
    rows = sql(f"""WITH c AS (SELECT * FROM {CALL}), s AS (SELECT x.target_id, time_days, flux_norm AS flux, epoch, period, depth, duration FROM curve_of_functions x JOIN c ON c.target_id = x.target_id AND candidate = 1)
      SELECT * FROM trapezoid_fit(TABLE(s) PARTITION BY target_id, key => 'target_id')""").collect()
    assert sorted((r["target_id"], round(r["period"], 1)) for r in rows) == [(1, 2.5), (2, 3.3)]
    assert all(r["status"] in ("fitted", "not_converged") and 0.005 < r["depth"] < 0.02 for r in rows)
    none = sql("WITH s AS (SELECT target_id, time_days, flux_norm AS flux, CAST(NULL AS DOUBLE) AS epoch, 1D AS period, 1D AS depth, 1D AS duration FROM curve_of_functions WHERE target_id = 1) SELECT * FROM trapezoid_fit(TABLE(s) PARTITION BY target_id, key => 'target_id')").collect()
    assert [r["status"] for r in none] == ["no_start_values"]


@pytest.mark.parametrize("call,reason", [("key => 'target_id', flux => 'nothing'", "no column"), ("key => 'target_id', what => 1", "unknown options: what"), ("key => 'target_id', flux => 'flux_norm', most => 0", "positive"), ("flux => 'flux_norm'", "key must name")])
def test_calls_are_checked_before_they_run(sql, call, reason):
    with pytest.raises(Exception, match=reason):
        sql(f"SELECT * FROM box_search(TABLE(curve_of_functions) PARTITION BY target_id, {call})")
