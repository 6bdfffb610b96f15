"""Gates that stop a job, frozen tables, printed digits, and checks before a joint fit."""

import pytest
from pyspark.sql import functions as F

from starfold.operators import gates, joint
from starfold.plans.labeling import printed_planets, transit_events
from starfold.sources import publish


def rows(spark, data, schema="target string, n long, t double, split string"):
    return spark.createDataFrame(data, schema)


GOOD = [("a", 1, 1.0, "train"), ("a", 2, 1.5, "train"), ("b", 1, 0.5, "train")]


@pytest.mark.parametrize(
    "gate,bad,reason",
    [
        (lambda x: gates.require_rows(x, time_is_positive=F.col("t") > 0), [("c", 1, -1.0, "train")], "time_is_positive"),
        (lambda x: gates.require_rows(x, time_is_positive=F.col("t") > 0), [("c", 1, None, "train")], "time_is_positive"),
        (lambda x: gates.strictly_increasing(x, ["target"], "n", "t"), [("a", 3, 1.5, "train")], "rise strictly"),
        (lambda x: gates.unique(x, "target", "n"), [("a", 2, 9.0, "train")], "target, n repeats"),
        (lambda x: gates.unique(x, "target", "n"), [(None, None, 9.0, "train")] * 2, "repeats"),
        (lambda x: gates.only_in(x, "split", "train", "calibration"), [("c", 1, 1.0, "holdout")], "must be one of"),
        (lambda x: gates.only_in(x, "split", "train"), [("c", 1, 1.0, None)], "must be one of"),
    ],
)
def test_a_gate_lets_good_rows_pass_and_fails_the_write(spark, tmp_path, gate, bad, reason):
    passed = gate(rows(spark, GOOD))
    assert sorted(map(tuple, passed.collect())) == GOOD and passed.columns == ["target", "n", "t", "split"]
    with pytest.raises(Exception, match=reason):
        gate(rows(spark, GOOD + bad)).write.parquet(str(tmp_path / "out"))
    assert gate(rows(spark, [])).count() == 0


def test_labels_and_assignments_agree(spark):
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "g long, label string")
    same = gates.same_groups(labels, spark.createDataFrame([(2, "y"), (1, "x")], "g long, label string"), "g", "label")
    assert sorted(map(tuple, same.collect())) == [(1, "x"), (2, "y")]
    for other, reason in ([(1, "x")], "no assignment"), ([(1, "x"), (2, "y"), (3, "z")], "no label"), ([(1, "x"), (2, "x")], "differ"):
        with pytest.raises(Exception, match=reason):
            gates.same_groups(labels, spark.createDataFrame(other, "g long, label string"), "g", "label").collect()


def test_counts_come_with_the_job_that_reads_the_rows(spark, tmp_path):
    x, seen = gates.counted(rows(spark, GOOD), late=F.col("t") > 1, none=F.col("t").isNull())
    x.write.parquet(str(tmp_path / "x"))
    assert seen.get == {"rows": 3, "late": 1, "none": 0}


def test_frozen_once(spark, tmp_path):
    target = str(tmp_path / "frozen" / "inventory")
    x = rows(spark, GOOD)
    stated = publish.freeze(x, target)
    assert stated["rows"] == 3 and publish.statement(spark, target) == stated
    assert publish.freeze(x.orderBy(F.desc("t")).select("split", "t", "n", "target"), target) == stated
    for other in (rows(spark, GOOD[:2]), rows(spark, GOOD + GOOD[:1]), rows(spark, [*GOOD[:2], ("b", 1, 0.6, "train")]), x.withColumn("n", F.col("n").cast("int")), x.withColumn("more", F.lit(1))):
        with pytest.raises(publish.FrozenDiffers):
            publish.freeze(other, target)
    assert sorted(map(tuple, publish.read_frozen(spark, target).collect())) == GOOD
    assert [p.name for p in (tmp_path / "frozen").iterdir()] == ["inventory"]


def test_columns_left_out_may_differ_and_nulls_count(spark, tmp_path):
    target = str(tmp_path / "f")
    x = rows(spark, GOOD + [(None, None, None, None)])
    publish.freeze(x.withColumn("found_at", F.lit("monday")), target, leave_out=["found_at"])
    assert publish.freeze(x.withColumn("found_at", F.lit("tuesday")), target)["rows"] == 4
    assert {r["found_at"] for r in publish.read_frozen(spark, target).collect()} == {"monday"}
    empty = str(tmp_path / "e")
    assert publish.freeze(rows(spark, []), empty)["rows"] == 0 and publish.read_frozen(spark, empty).count() == 0


def test_a_write_that_fails_leaves_nothing_to_see(spark, tmp_path):
    target = str(tmp_path / "f")
    with pytest.raises(Exception, match="lost"):
        publish.freeze(gates.require_rows(rows(spark, GOOD), lost=F.col("n") < 2), target)
    assert not publish.exists(spark, target)
    assert publish.freeze(rows(spark, GOOD), target)["rows"] == 3


def test_a_rename_never_replaces(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    with pytest.raises(Exception, match="(?i)exist"):
        publish.rename(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b" / "x").read_text() == "b" and (tmp_path / "a").exists()
    publish.rename(spark, str(tmp_path / "a"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "x").read_text() == "a"


def test_a_frozen_table_that_was_touched_is_found_out(spark, tmp_path):
    target = tmp_path / "f"
    publish.freeze(rows(spark, GOOD).coalesce(1), str(target))
    rows(spark, [("z", 1, 1.0, "train")]).write.mode("append").parquet(str(target))
    with pytest.raises(publish.FrozenDiffers):
        publish.read_frozen(spark, str(target))


def test_printed_digits(spark):
    archive = [(1, 1, "3.5", "2457001.25", "2"), (1, 2, "1.20E+1", "2457000", "2.0"), (1, 3, "n/a", "2457001.0", "2"), (1, 4, None, None, None), (1, 5, " 4 ", "2457000.123456789", "1e0")]
    x = printed_planets(spark.createDataFrame(archive, "target_id long, record_id long, period string, epoch_bjd string, hours string"))
    got = {r["record_id"]: (r["period"], r["epoch"], r["hours"], r["period_bound"], r["epoch_bound"]) for r in x.collect()}
    assert got[1] == (3.5, 1.25, 2.0, 0.05, 0.005) and got[2] == (12.0, 0.0, 2.0, 0.05, 0.5)
    assert got[3][0] is None and got[3][3] == 0.0 and got[4] == (None, None, None, 0.0, 0.0)
    assert got[5] == pytest.approx((4.0, 0.123456789, 1.0, 0.5, 0.5e-9), rel=1e-15)
    products = spark.createDataFrame([("p", 1, 10.6, 10.9, True), ("q", 1, 40.1, 40.2, True)], "product_id string, target_id long, start double, stop double, verified boolean")
    events = {(r["product_id"], r["record_id"]): r["event_match_status"] for r in transit_events(products, x).collect()}
    assert events["p", 3] == events["q", 4] == "unlabeled_transit_ephemeris_incomplete"
    assert events["q", 5].startswith("transit_window")  # ten cycles of half a day each


CADENCES = "target_id string, product_id string, cadence long, time_days double, flux double, flux_error double"


def judged(spark, products, exposures=None):
    """{target: {product: [(time, flux, error)]}} -> {target: (product, status)}"""
    cad = [(t, p, i, *(None if v is None else float(v) for v in c)) for t, group in products.items() for p, series in group.items() for i, c in enumerate(series)]
    prod = [(t, p, 0.01) for t, group in products.items() for p in group] if exposures is None else exposures
    out = joint.joint_status(spark.createDataFrame(cad, CADENCES), spark.createDataFrame(prod, "target_id string, product_id string, exposure_days double"))
    return {r["target_id"]: (r["product_id"], r["status"]) for r in out.collect()}


def line(start, n=4, step=0.1, flux=1.0, error=0.1):
    return [(start + i * step, flux, error) for i in range(n)]


def test_joint_faults(spark):
    nan = float("nan")
    other = line(5.0)
    cases = {
        "valid": {"a": line(0.0), "b": other},
        "fewer_than_two_products": {"a": line(0.0)},
        "time_not_increasing": {"a": [(0.0, 1, 0.1), (0.0, 1, 0.1), (0.1, 1, 0.1)], "b": other},
        "not_finite": {"a": [(0.0, 1, 0.1), (0.1, nan, 0.1), (0.2, 1, 0.1)], "b": other},
        "not_normalized": {"a": line(0.0, flux=1.2), "b": other},
        "flux_error_invalid": {"a": [(0.0, 1, 0.1), (0.1, 1, 0.0), (0.2, 1, 0.1)], "b": other},
        "mixed_flux_error": {"a": line(0.0, error=None), "b": other},
        "exposures_overlap_within": {"a": line(0.0, step=0.005), "b": other},
        "exposures_overlap_across": {"a": [(0.1, 1, 0.1), (0.2, 1, 0.1)], "b": [(0.105, 1, 0.1), (0.25, 1, 0.1)]},
        "exposure_exceeds_span": {"a": line(0.0, n=2, step=0.001), "b": other},
        "missing_product_id": {" ": line(0.0), "b": other},
    }
    got = judged(spark, cases)
    assert {t: s for t, (_, s) in got.items()} == {t: t for t in cases}
    assert got["not_finite"][0] == "a" and got["valid"][0] is None


def test_joint_faults_of_the_product_table(spark):
    series = {"x": {"a": line(0.0), "b": line(5.0)}}
    cases = {"duplicate_product_id": [("x", "a", 0.01), ("x", "a", 0.01), ("x", "b", 0.01)], "no_cadences": [("x", "a", 0.01), ("x", "c", 0.01)], "exposure_not_positive": [("x", "a", 0.0), ("x", "b", 0.01)]}
    for status, exposures in cases.items():
        assert judged(spark, series, exposures)["x"][1] == status
    touching = {"x": {"a": [(0.0, 1, None), (1.0, 1, None)], "b": [(0.5, 1, None), (1.5, 1, None)]}}
    assert judged(spark, touching, [("x", "a", 0.5), ("x", "b", 0.5)])["x"][1] == "valid"
    inside = {"x": {"a": [(0.0, 1, None), (9.0, 1, None)], "b": [(-2.0, 1, None), (-1.0, 1, None), (2.0, 1, None)]}}
    assert judged(spark, inside, [("x", "a", 8.0), ("x", "b", 0.5)])["x"][1] == "exposures_overlap_across"
