"""Evaluation: calibration, classification scores, abstention, audits, bootstrap.

Predictions are rows with ``truth`` (a class), ``probabilities`` (an array in the order of
``classes``) and, where it matters, ``abstained``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(probabilities: Column) -> Column:
    """(confidence, margin, index): the largest probability, its lead, and the first place that has it."""
    ordered = F.array_sort(probabilities, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    return F.struct(ordered[0].alias("confidence"), (ordered[0] - ordered[1]).alias("margin"), (F.array_position(probabilities, ordered[0]) - 1).cast("bigint").alias("index"))


def predicted(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Add ``confidence``, ``margin`` and ``prediction``."""
    x = rows.withColumn("_t", top(F.col("probabilities")))
    name = F.array(*[F.lit(c) for c in classes])
    return x.select(*rows.columns, F.col("_t.confidence").alias("confidence"), F.col("_t.margin").alias("margin"), F.get(name, F.col("_t.index").cast("int")).alias("prediction"))


def expected_calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Gap of accuracy and confidence over bins (low, high], weighted by their rows; confidence 0 is in no bin."""
    b = rows.withColumn("_b", F.ceil(F.col("confidence") * bins)).groupBy("_b").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("prediction")).cast("double")).alias("acc"), F.avg("confidence").alias("conf"))
    total = rows.agg(F.count("*").alias("total"))
    return b.filter("_b > 0").crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("n") / F.col("total") * F.abs(F.col("acc") - F.col("conf"))), F.lit(0.0)).alias("ece"))


def brier(rows: DataFrame, classes: list[str]) -> DataFrame:
    hot = F.array(*[(F.col("truth") == c).cast("double") for c in classes])
    each = F.aggregate(F.zip_with("probabilities", hot, lambda p, h: (p - h) * (p - h)), F.lit(0.0), lambda a, b: a + b)
    return rows.agg(F.coalesce(F.avg(each), F.lit(0.0)).alias("brier"))


def classification(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Precision, recall and F1 of each class; rows that abstain count as missed."""
    kinds = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    said, true = (~F.col("abstained")) & (F.col("prediction") == F.col("class")), F.col("truth") == F.col("class")
    g = rows.join(F.broadcast(kinds), true | said).groupBy("class").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    g = kinds.join(g, "class", "left").fillna(0)
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = zero(F.col("tp"), F.col("tp") + F.col("fp")), zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("class", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), zero(2 * p * r, p + r).alias("f1"))


def scores(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy and coverage; rows that abstain are wrong."""
    c = classification(rows, classes)
    macro = c.agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
    whole = rows.agg(F.avg((~F.col("abstained") & (F.col("truth") == F.col("prediction"))).cast("double")).alias("accuracy"), F.avg((~F.col("abstained")).cast("double")).alias("coverage"))
    return whole.crossJoin(macro)


def confusion(rows: DataFrame, classes: list[str]) -> DataFrame:
    return rows.groupBy("truth").pivot("prediction", classes).count().fillna(0)


def abstain(rows: DataFrame, least_confidence: float, least_margin: float, outside: Column | None = None) -> DataFrame:
    """Add ``abstained``: unsure, undecided, or outside of what was learned; then ``prediction`` is null."""
    unsure = (F.col("confidence") < least_confidence) | (F.col("margin") < least_margin) | (outside if outside is not None else F.lit(False))
    return rows.withColumn("abstained", unsure).withColumn("prediction", F.when(~unsure, F.col("prediction")))


#: Thresholds that tuning tries.
CONFIDENCES, MARGINS = (0.4, 0.5, 0.6, 0.7, 0.8), (0.1, 0.15, 0.2, 0.25, 0.3)


def tune_abstention(rows: DataFrame, least_coverage: float = 0.75) -> DataFrame:
    """Thresholds with the best harmonic mean of accuracy and coverage; the first of equals; (0.5, 0.15) if none covers enough."""
    grid = F.array(*[F.struct(F.lit(i * len(MARGINS) + j).alias("k"), F.lit(c).alias("c"), F.lit(m).alias("m")) for i, c in enumerate(CONFIDENCES) for j, m in enumerate(MARGINS)])
    x = rows.select("confidence", "margin", (F.col("truth") == F.col("prediction")).alias("good"), F.explode(grid).alias("g"))
    covered = (F.col("confidence") >= F.col("g.c")) & (F.col("margin") >= F.col("g.m"))
    t = x.groupBy("g").agg(F.avg(covered.cast("double")).alias("coverage"), F.coalesce(F.avg(F.when(covered, F.col("good").cast("double"))), F.lit(0.0)).alias("acc")).filter(F.col("coverage") >= least_coverage)
    t = t.withColumn("score", F.round(2 * F.col("acc") * F.col("coverage") / (F.col("acc") + F.col("coverage") + 1e-6), 12))
    best = t.agg(F.max_by("g", F.struct("score", -F.col("g.k"))).alias("g"))
    return best.select(F.coalesce("g.c", F.lit(0.5)).alias("least_confidence"), F.coalesce("g.m", F.lit(0.15)).alias("least_margin"))


def outside_bounds(values: dict[str, Column], bounds: dict[str, tuple[float, float]], spans: float = 5.0) -> Column:
    """Whether any feature lies more than ``spans`` spans beyond what was seen."""
    out = F.lit(False)
    for name, x in values.items():
        low, high = bounds[name]
        width = max(high - low, 1e-6)
        out = out | (x < low - spans * width) | (x > high + spans * width)
    return out


def ks_excess(rows: DataFrame, p: str, bins: int = 4096) -> DataFrame:
    """Largest excess of the empirical distribution of p-values over the uniform one, and counts.

    Counts of p-value bins are summed up first, so ranks need no global sort of the rows.
    """
    x = rows.withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    sizes = x.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    y = x.join(F.broadcast(before.withColumn("_total", total)), "_b")
    rank = F.rank().over(Window.partitionBy("_b").orderBy(p)) - 1 + F.count("*").over(Window.partitionBy("_b", p)) + F.col("_before")
    return y.select(F.col(p).alias("p"), (rank / F.col("_total")).alias("cdf")).agg(F.count("*").alias("n"), F.count_if(F.col("p") <= 0.05).alias("alerts"), F.greatest(F.max(F.col("cdf") - F.col("p")), F.lit(0.0)).alias("excess"))


def grouped_bootstrap(rows: DataFrame, group: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Percentile interval of the accuracy when whole groups are drawn with replacement.

    A group's multiplicity in a replicate is Poisson(1), from a hash of the group, the replicate and
    the seed; repeated draws count as often as they come. Rows are summed by group before they multiply.
    """
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("prediction")).alias("good"))
    u = F.pmod(F.xxhash64(F.col(group), F.col("replicate"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    times = sum([F.when(u >= c, 1).otherwise(0) for c in cuts[1:]], F.when(u >= cuts[0], 1).otherwise(0))
    drawn = g.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("times", times).filter("times > 0")
    each = drawn.groupBy("replicate").agg((F.sum(F.col("times") * F.col("good")) / F.sum(F.col("times") * F.col("n"))).alias("accuracy"))
    return each.agg(F.percentile("accuracy", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def counts_by_sets(rows: DataFrame, *sets: list[str]) -> DataFrame:
    """Row counts over several groupings at once."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"))
