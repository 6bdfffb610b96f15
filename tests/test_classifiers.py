"""Classifiers: temperature, choice of a family, and models that are stored with their hashes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import classify
from starfold.plans import labeling

CLASSES = ["transit", "eclipse", "noise"]


def loss(z, y, t):
    v = z / t
    v = v - v.max(axis=1, keepdims=True)
    return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]).mean())


def least(z, y):
    """A plain search for the best logarithm of a temperature, by golden sections."""
    low, high, g = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(200):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(z, y, np.exp(a)) < loss(z, y, np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


@pytest.mark.parametrize("scale", [0.2, 1.0, 6.0])
def test_temperature_equals_a_plain_minimizer(spark, scale):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 400)
    z = rng.normal(size=(400, 3)) + 1.4 * np.eye(3)[y]
    z *= scale
    rows = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(z, y, strict=True)] + [(None, 1), ([1.0, 2.0, 3.0], None)], "logits array<double>, label int")
    t, before, after = classify.temperature(rows, "logits", "label")
    assert t == pytest.approx(least(z, y), abs=1e-6) and before == pytest.approx(loss(z, y, 1.0)) and after == pytest.approx(loss(z, y, t)) and after <= before
    p = np.array([r["probabilities"] for r in classify.tempered(rows.filter("label IS NOT NULL AND logits IS NOT NULL"), "logits", t).collect()])
    v = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
    assert np.allclose(p, v / v.sum(axis=1, keepdims=True))


def test_temperature_at_its_bounds(spark):
    sure = spark.createDataFrame([([5.0, 0.0, 0.0], 0), ([0.0, 5.0, 0.0], 1)], "logits array<double>, label int")
    assert classify.temperature(sure, "logits", "label")[0] == pytest.approx(np.exp(-3), rel=1e-3)  # never wrong: as sure as may be
    wrong = spark.createDataFrame([([5.0, 0.0, 0.0], 1), ([0.0, 5.0, 0.0], 2)], "logits array<double>, label int")
    assert classify.temperature(wrong, "logits", "label")[0] == pytest.approx(np.exp(3), rel=1e-3)
    with pytest.raises(ValueError, match="no rows"):
        classify.temperature(sure.limit(0), "logits", "label")


def test_choice_by_macro_f1_then_recall():
    assert classify.choose({"a": (0.8, 0.5), "b": (0.9, 0.1), "c": (0.9005, 0.05)}) == "c"
    assert classify.choose({"a": (0.9, 0.5), "b": (0.8995, 0.6)}) == "b"
    assert classify.choose({"a": (0.9, 0.5), "b": (0.8, 0.9)}) == "a"
    with pytest.raises(ValueError):
        classify.choose({})


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(180):
        k = i % 3
        x = rng.normal(size=3) + 3.0 * np.eye(3)[k]
        rows.append((i, i // 3 % 20, CLASSES[k], *map(float, x)))
    return spark.createDataFrame(rows, "id long, group long, truth string, f0 double, f1 double, f2 double").cache()


def test_families_are_compared_over_groups(vectors):
    scores = classify.compare(vectors, ["f0", "f1", "f2"], CLASSES, "truth", "group", ("logistic",), folds=2)
    assert scores["logistic"][0] > 0.85 and scores["logistic"][1] > 0.8
    folds = classify.grouped_folds(vectors, "group", 5)
    assert folds.groupBy("group").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_models_are_stored_once_and_checked(spark, vectors, tmp_path):
    model = classify.train(vectors, ["f0", "f1", "f2"], CLASSES, "truth", "group", "logistic")
    folder = str(tmp_path / "store" / "m1")
    classify.save(model, folder, classes=CLASSES, temperature=1.5)
    loaded, about = classify.load(spark, folder)
    assert about == {"classes": CLASSES, "temperature": 1.5}
    a, b = (classify.predict(m, vectors, CLASSES).select("id", "probabilities").orderBy("id").collect() for m in (model, loaded))
    assert a == b
    with pytest.raises(Exception, match="(?i)exist"):
        classify.save(model, folder)
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.endswith(".part")) == ["m1"]
    touched = next(p for p in (tmp_path / "store" / "m1" / "model").rglob("part-*") if not p.name.endswith(".crc"))
    touched.write_bytes(touched.read_bytes() + b" ")
    (touched.parent / f".{touched.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="aren't as they were saved"):
        classify.load(spark, folder)
    assert json.loads((tmp_path / "store" / "m1" / "_frozen.json").read_text())["about"]["temperature"] == 1.5


def test_events_of_catalogs(spark):
    schema = "product_id string, record_id string, catalog string, event_match_status string, period double, epoch double, hours double"
    t = spark.createDataFrame([("p", "b", None, labeling.TRANSIT_INSIDE, 2.0, 1.0, 3.0), ("p", "c", None, "transit_ephemeris_outside_product_interval", 2.0, 1.0, 3.0), ("q", None, None, labeling.TRANSIT_INSIDE, 2.0, 1.0, 99.0), ("q", "z", None, labeling.TRANSIT_INSIDE, 0.0, 1.0, 3.0)], schema)
    e = spark.createDataFrame([("p", "7", "k", labeling.ECLIPSE_INSIDE, 5.0, 2.0, None), ("r", "8", None, labeling.ECLIPSE_INSIDE, 5.0, float("nan"), 1.0), ("s", "9", None, labeling.ECLIPSE_INSIDE, 5.0, 0.5, 1.0)], schema)
    d = spark.createDataFrame([("p", 1, "1.01", True, "PC", None, 3.0, 4.0, 2.0), ("p", 1, "1.02", False, "PC", None, 3.0, 4.0, 2.0), ("p", 1, "1.03", True, "EB", None, 3.0, 4.0, 2.0), ("p", 1, "1.04", True, "PC", "FP", 3.0, 4.0, 2.0)], "product_id string, target_id long, record_id string, sector_match boolean, disposition string, followup string, period double, epoch double, hours double")
    assert {tuple(r) for r in labeling.event_records(t, e, d).collect()} == {
        ("p", "transit_like", "confirmed_planets", "b", 2.0, 1.0, 3.0), ("q", "transit_like", "confirmed_planets", "unknown", 2.0, 1.0, None),
        ("p", "eclipse_like", "eb:k", "7", 5.0, 2.0, None), ("s", "eclipse_like", "eb:catalog", "9", 5.0, 0.5, 1.0), ("p", "transit_like", "dispositions", "1.01", 3.0, 4.0, 2.0),
    }
    labels = spark.createDataFrame([("p", "a", "00", "transit_like"), ("z", "b", "00", "transit_like")], "product_id string, target_id string, sha256 string, label string")
    rows = labeling.freeze_rows(labels, labeling.event_records(t, e, d), "hosts").collect()
    assert sorted((r["product_id"], r["event"]["record_id"] if r["event"] else None) for r in rows if r["event"]) == [("p", "1.01"), ("p", "b")] and any(r["product_id"] == "z" and r["event"] is None for r in rows)


def test_combined_labels(spark):
    x = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, None, "b"), (4, "a", None), (5, None, None)], "product_id long, label string, eclipse_label string")
    got = {r["product_id"]: (r["label"], r["label_status"]) for r in labeling.combined_labels(x).collect()}
    assert got == {1: (None, "unlabeled_conflicting_eb_and_toi_proxy_classes"), 2: ("a", "both_catalog_overlays_same_class"), 3: ("b", "eb_catalog_proxy_only"), 4: ("a", "toi_catalog_proxy_only"), 5: (None, "unlabeled_in_both_catalog_overlays")}
