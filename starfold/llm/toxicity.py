"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.common import WordHashes, hash_bytes, lean, mix64, others, small

_TRIM = bytes(set(range(0x21, 0x80)) - set(b"0123456789abcdefghijklmnopqrstuvwxyz"))


class _Words(WordHashes):
    """Words hash without the ASCII punctuation around them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = hash_bytes(word.strip(_TRIM) or word)
        return value


class Features:
    """Sorted distinct slots of a text's words, word pairs and pairs with one word between."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.words = _Words()

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        h = self.words.of(words)
        pairs = h[:-1] * np.uint64(3) + h[1:] * np.uint64(5)
        skips = h[:-2] * np.uint64(7) + h[2:] * np.uint64(11)
        return np.unique(mix64(np.concatenate([h, pairs, skips])) >> self.shift).astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate rates alpha / (beta + sqrt(sum of squared gradients)); ``l1`` keeps weak coordinates at zero; ``rare`` weighs the gradients of label 1."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 4
    rare: float = 4.0

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
        """(slots, weights, bias) of the coordinates that aren't zero."""
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        order = np.random.default_rng(seed)
        for _ in range(self.epochs):
            for i in order.permutation(len(rows)):
                at = np.append(rows[i], size)
                w = self._weights(z[at], n[at], at == size)
                p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
                g = (p - labels[i]) * (self.rare if labels[i] else 1.0)
                grown = n[at] + g * g
                z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / self.alpha * w
                n[at] = grown
        w = self._weights(z, n, np.arange(size + 1) == size)
        slots = np.flatnonzero(w[:size])
        return slots, w[slots], float(w[size])

    def _weights(self, z: np.ndarray, n: np.ndarray, free: np.ndarray) -> np.ndarray:
        l1 = np.where(free, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        dense = np.zeros(1 << self.bits)
        dense[self.slots] = self.weights
        features = Features(self.bits)
        return lambda text: float(1 / (1 + np.exp(-np.clip(dense[features.of(text)].sum() + self.bias, -35, 35))))


def bounded_labels(labels: DataFrame, key: str, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows, those of smallest hash: their number doesn't grow with the table."""
    held = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    return held.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64("_key"), "_key", "_label").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 16_000, bits: int = 20, ftrl: Ftrl = Ftrl()) -> ToxicityModel:
    """Train on at most ``max_rows`` labelled documents (a bound of the method, not of the data).

    Features are made on the executors; their slots come to the driver, which runs the
    sequential updates. Null labels or keys don't count; a null text is empty. With no
    labelled rows the model scores 0.5 throughout.
    """
    sample = F.broadcast(bounded_labels(labels, key, label, max_rows))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(sample, "_key").select("_key", "_text", "_label")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in stream:
            slots = [features.of(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(slots, pa.binary())], names=["_key", "_label", "slots"])

    rows = sorted(tuple(r) for r in texts.mapInArrow(lean(run), T.StructType([texts.schema["_key"], T.StructField("_label", T.IntegerType()), T.StructField("slots", T.BinaryType())])).collect())
    if not rows:
        return ToxicityModel(bits, np.empty(0, np.int64), np.empty(0), 0.0)
    slots, weights, bias = ftrl.fit([np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows], np.array([r[1] for r in rows]), 1 << bits)
    return ToxicityModel(bits, slots, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability of label 1, to every row; null and empty texts get the bias's probability.

    Reads nothing but the text. Other columns stay; a column called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_score(docs, text, out, lambda: shared.value.scorer())


def with_score(docs: DataFrame, text: str, out: str, make) -> DataFrame:
    """Add a double column made from each row's text by the function that ``make`` returns in the task."""
    keep = others(docs, out)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in small(stream):
            values = [work(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(values, pa.float64())], names=[*keep, out])

    return docs.mapInArrow(lean(run), schema)
