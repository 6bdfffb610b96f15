"""Classification of feature vectors with MLlib: grouped folds, selection, Platt calibration."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions import series as S
from starfold.operators import metrics as M
from starfold.sources import catalogs, publish


def grouped_folds(rows: DataFrame, group: str, folds: int = 5, seed: str = "42") -> DataFrame:
    """Add ``fold``: all rows of a group share it."""
    return rows.withColumn("fold", (S.hash_number(F.concat_ws(":", F.lit(seed), F.col(group).cast("string"))) % folds).cast("int"))


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: each class counts the same as a whole."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def families(label: str = "label_index") -> dict[str, list]:
    return {
        "forest": [RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=8, seed=42, weightCol="weight")],
        "boosted": [OneVsRest(labelCol=label, classifier=GBTClassifier(maxDepth=6, maxIter=20, seed=42), weightCol="weight")],
        "logistic": [StandardScaler(inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=100)],
    }


def train(rows: DataFrame, features: list[str], classes: list[str], label: str, group: str, family: str = "forest") -> PipelineModel:
    """A model of one family on all rows; null features must be filled before."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("double") - 1
    data = balanced(rows.filter(F.col(label).isin(classes)), label).withColumn("label_index", index)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), *families()[family]]).fit(data)


def cross_validate(rows: DataFrame, features: list[str], classes: list[str], label: str, group: str, family: str = "forest", folds: int = 3) -> DataFrame:
    """Out-of-fold predictions: each row is predicted by a model that saw none of its group."""
    dealt = grouped_folds(rows, group, folds)
    out = None
    for k in range(folds):
        model = train(dealt.filter(F.col("fold") != k), features, classes, label, group, family)
        part = predict(model, dealt.filter(F.col("fold") == k), classes)
        out = part if out is None else out.unionByName(part)
    return out


def predict(model: PipelineModel, rows: DataFrame, classes: list[str]) -> DataFrame:
    """Add ``probabilities`` in the order of the classes, and confidence, margin and prediction."""
    scored = model.transform(rows)
    raw = vector_to_array("probability") if "probability" in scored.columns else F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-v)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
    return M.predicted(scored.select(*rows.columns, F.transform(raw, lambda v: v / total).alias("probabilities")), classes)


def platt(held: DataFrame, classes: list[str], truth: str = "truth") -> dict[str, tuple[float, float]]:
    """For each class the (slope, intercept) of a logistic curve of its score, from held-out rows."""
    out = {}
    for i, c in enumerate(classes):
        x = held.select(F.get("probabilities", F.lit(i)).alias("s"), (F.col(truth) == c).cast("double").alias("y"))
        m = Pipeline(stages=[VectorAssembler(inputCols=["s"], outputCol="v"), LogisticRegression(featuresCol="v", labelCol="y")]).fit(x).stages[-1]
        out[c] = (float(m.coefficients[0]), float(m.intercept))
    return out


def calibrated(rows: DataFrame, curves: dict[str, tuple[float, float]], classes: list[str]) -> DataFrame:
    """``probabilities`` by the curves, adding up to 1 again."""
    p = [1 / (1 + F.exp(-(F.lit(curves[c][0]) * F.get("probabilities", F.lit(i)) + F.lit(curves[c][1])))) for i, c in enumerate(classes)]
    return rows.withColumn("probabilities", F.transform(F.array(*p), lambda v: v / sum(p[1:], p[0])))


#: The bounds of the logarithm of a temperature.
LOG_TEMPERATURE = (-3.0, 3.0)


def _losses(rows: DataFrame, logits: str, label: str, inverse: float) -> tuple[int, float, float, float]:
    """(rows, mean loss, slope, curvature) of the cross-entropy in the inverse temperature, in one aggregation."""
    z, y = F.col(logits), F.col(label).cast("int")
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(F.lit(inverse) * (v - top)))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    weights = rows.filter(z.isNotNull() & y.isNotNull()).select(z.alias("z"), top.alias("top"), e.alias("e"), add(e).alias("s"), F.get(z, y).alias("own"))
    first = add(F.zip_with("e", F.transform("z", lambda v: v - F.col("top")), lambda a, b: a * b)) / F.col("s")
    second = add(F.zip_with("e", F.transform("z", lambda v: (v - F.col("top")) * (v - F.col("top"))), lambda a, b: a * b)) / F.col("s")
    own = F.col("own") - F.col("top")
    r = weights.select(F.log("s").alias("l"), first.alias("m"), second.alias("q"), own.alias("own")).agg(
        F.count("own").alias("n"), F.avg(F.col("l") - inverse * F.col("own")).alias("loss"), F.avg(F.col("m") - F.col("own")).alias("slope"), F.avg(F.col("q") - F.col("m") * F.col("m")).alias("curve")
    ).first()
    return r["n"], r["loss"], r["slope"], r["curve"]


def temperature(rows: DataFrame, logits: str, label: str, tolerance: float = 1e-9, steps: int = 60) -> tuple[float, float, float]:
    """(temperature, mean loss without it, mean loss with it) of least cross-entropy, by which ``logits`` (an array) are divided.

    ``label`` is the place of the true class. Rows with nulls count nothing; without rows, an error. The loss is convex in the inverse temperature, so
    Newton steps on its sums, kept between bounds that close in, find the least one; each step is one aggregation, and no row comes to the driver.
    """
    low, high = np.exp(-LOG_TEMPERATURE[1]), np.exp(-LOG_TEMPERATURE[0])
    at = 1.0
    n, before, slope, curve = _losses(rows, logits, label, at)
    if not n:
        raise ValueError("no rows to find a temperature by")
    for bound, sign in ((high, -1), (low, 1)):  # the least loss may lie beyond a bound
        _, loss, there, _ = _losses(rows, logits, label, bound)
        if sign * there >= 0:
            return float(1 / bound), before, loss
    for _ in range(steps):
        low, high = (at, high) if slope < 0 else (low, at)
        step = at - slope / curve if curve > 0 else -1.0
        to = step if low < step < high else (low + high) / 2
        moved, at = abs(to - at), to
        _, loss, slope, curve = _losses(rows, logits, label, at)
        if moved <= tolerance * at or high - low <= tolerance * at:
            break
    return float(1 / at), before, loss


def tempered(rows: DataFrame, logits: str, by: float, out: str = "probabilities") -> DataFrame:
    """``out``: the softmax of the logits over the temperature."""
    top = F.array_max(F.col(logits))
    e = F.transform(F.col(logits), lambda v: F.exp((v - top) / by))
    return rows.withColumn(out, e).withColumn(out, F.transform(out, lambda v: v / F.aggregate(F.col(out), F.lit(0.0), lambda a, b: a + b)))


def compare(rows: DataFrame, features: list[str], classes: list[str], label: str, group: str, names: tuple[str, ...] = ("forest", "boosted", "logistic"), folds: int = 5) -> dict[str, tuple[float, float]]:
    """family -> (macro F1, recall of the first class) over grouped folds; scores come from the confusion's counts."""
    found = {}
    for name in names:
        guess = cross_validate(rows, features, classes, label, group, name, folds).withColumns({"truth": F.col(label), "abstained": F.lit(False)})
        by = {r["class"]: r for r in M.classification(guess, classes).collect()}  # a row a class
        f1 = [by[c]["f1"] or 0.0 for c in classes if c in by]
        found[name] = (sum(f1) / max(len(f1), 1), float(by[classes[0]]["recall"] or 0.0) if classes[0] in by else 0.0)
    return found


def choose(scores: dict[str, tuple[float, float]], close: float = 1e-3) -> str:
    """In the order given: the family of higher macro F1; of those as close as ``close``, the one of higher recall."""
    best = None
    for name, (f1, recall) in scores.items():
        if best is None or f1 > scores[best][0] or (abs(f1 - scores[best][0]) <= close and recall > scores[best][1]):
            best = name
    if best is None:
        raise ValueError("nothing to choose from")
    return best


def save(model: PipelineModel, folder: str, **about) -> dict:
    """Write a model and what is said about it into a new folder, with the hash of every file; a folder that exists is an error.

    The folder appears under its name by one rename, once all is written.
    """
    spark = SparkSession.getActiveSession()
    aside = f"{folder.rstrip('/')}.{uuid.uuid4().hex}.part"
    model.write().save(f"{aside}/model")
    files = catalogs.integrity(spark, f"{aside}/model").filter(~F.col("path").contains(".crc"))
    known = {r["path"]: r["sha256"] for r in files.collect()}  # a model's files, not its data
    stated = {"about": about, "files": dict(sorted(known.items()))}
    publish.write_text(spark, f"{aside}/{publish.STATEMENT}", json.dumps(stated, indent=2, sort_keys=True) + "\n")
    publish.rename(spark, aside, folder)
    return stated


def load(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    """(model, what was said about it), after every file's hash has been compared; one that differs, lacks or is too many is an error."""
    stated = publish.statement(spark, folder)
    files = catalogs.integrity(spark, f"{folder.rstrip('/')}/model").filter(~F.col("path").contains(".crc"))
    now = {r["path"]: r["sha256"] for r in files.collect()}
    if wrong := sorted(k for k in {*now, *stated["files"]} if now.get(k) != stated["files"].get(k)):
        raise ValueError(f"{folder}: files that aren't as they were saved: {', '.join(wrong[:5])}")
    return PipelineModel.load(f"{folder.rstrip('/')}/model"), stated["about"]
