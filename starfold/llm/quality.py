"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word slot has a sparse ternary index vector, drawn from its number. A slot's word
vector is the sum of the index vectors of its neighbours over the whole corpus. A word
gives two slots: its lower-cased core and its shape (case, digits, punctuation, and
whether it repeats the word before), so that layout counts as well as vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.bpe import _Remembered
from starfold.llm.common import lean, mix64
from starfold.llm.toxicity import bounded_labels, with_score


@dataclass(frozen=True)
class Indexing:
    """``slots`` hashed words, vectors of ``width``, each index vector with ``spikes`` entries of +-1, ``window`` neighbours on either side."""

    slots: int = 1 << 13
    width: int = 48
    spikes: int = 2
    window: int = 2

    def spike(self) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(np.arange(2 * self.slots * self.spikes, dtype=np.uint64) + np.uint64(12345)).reshape(-1, self.spikes)
        return (h % np.uint64(self.width)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


class Slots:
    """word -> (core slot, shape slot); shapes use the upper half of the numbers, a repeat the next shape over."""

    _lower, _upper = re.compile("[a-zß-öø-ÿ]+"), re.compile("[A-ZÀ-ÖØ-Þ]+")

    def __init__(self, slots: int, limit: int = 100_000):
        self.slots = slots
        self.known = _Remembered(self._number, limit)

    def _shape(self, word: str) -> str:
        body, end = (word[:-1], word[-1]) if word[-1] in ".," else (word, "")
        if body.isalpha():
            if body.islower():
                return "a" + end
            if body.isupper():
                return ("AA" if len(body) > 1 else "A") + end
            if body.istitle():
                return "Aa" + end
        return re.sub(r"\d+", "9", self._upper.sub(lambda m: "A" if len(m[0]) == 1 else "AA", self._lower.sub("a", word)))[:12]

    def _number(self, word: str) -> int:
        core = zlib.crc32(word.lower().strip(".,;:!?|*$%&#\"'()[]").encode("utf-8", "surrogatepass")) % self.slots
        return core * self.slots + zlib.crc32(self._shape(word).encode("utf-8", "surrogatepass")) % (self.slots // 2)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        both = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        core, shape = both // self.slots, both % self.slots
        shape[1:] += (both[1:] == both[:-1]) * (self.slots // 2)
        return core, shape + self.slots


def word_vectors(docs: DataFrame, text: str = "text", indexing: Indexing = Indexing()) -> np.ndarray:
    """Unit word vectors of all slots, from every word of every text.

    Each task sums its part and sends the sums in pieces; Spark adds the pieces. What
    reaches the driver is one row a slot, whatever the corpus.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = indexing.spike()
        slots, width = Slots(indexing.slots), indexing.width
        total = np.zeros(2 * indexing.slots * width)
        seen = np.zeros(2 * indexing.slots)

        def add(parts: list[np.ndarray]) -> None:
            if not parts:
                return
            x = np.concatenate(parts)
            seen[:] += np.bincount(x[x >= 0], minlength=len(seen))
            for gap in range(1, indexing.window + 1):
                left, right = x[:-gap], x[gap:]
                both = (left >= 0) & (right >= 0)
                left, right = left[both], right[both]
                for a, b in ((left, right), (right, left)):
                    for k in range(indexing.spikes):
                        total[:] += np.bincount(a * width + at[b, k], sign[b, k], minlength=len(total))

        apart = np.full(indexing.window, -1)
        for batch in stream:
            parts, held = [], 0
            for value in batch.column(0):
                for stream_of in slots.of(value.as_py()):
                    parts += [stream_of, apart]
                    held += len(stream_of)
                if held > 400_000:
                    add(parts)
                    parts, held = [], 0
            add(parts)
        for start in range(0, len(seen), 512):
            block = total[start * width : (start + 512) * width]
            if block.any() or seen[start : start + 512].any():
                payload = np.concatenate([block, seen[start : start + 512]]).astype("<f4")
                yield pa.RecordBatch.from_pydict({"block": pa.array([start], pa.int32()), "sums": pa.array([payload], pa.list_(pa.float32()))})

    def fold(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in stream:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = values.values.to_numpy().astype(float)
                sums[block] = sums[block] + part if block in sums else part
        for block, values in sorted(sums.items()):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": pa.array([values.astype("<f4")], pa.list_(pa.float32()))})

    schema = "block int, sums array<float>"
    pieces = docs.select(text).mapInArrow(lean(run), schema)
    rows = pieces.repartition(8, "block").mapInArrow(lean(fold), schema).collect()
    vectors = np.zeros((2 * indexing.slots, indexing.width))
    seen = np.zeros(2 * indexing.slots)
    for block, values in rows:
        values = np.asarray(values)
        n = len(values) // (indexing.width + 1)
        vectors[block : block + n] = values[: n * indexing.width].reshape(n, -1)
        seen[block : block + n] = values[n * indexing.width :]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    rare = 1e-3 / (1e-3 + seen / max(seen.sum(), 1))
    return np.where((seen > 0)[:, None], vectors * rare[:, None], 0).astype(np.float32)


class Pool:
    """A text's vector: means of its core and shape vectors, and the logarithm of its length."""

    def __init__(self, vectors: np.ndarray, slots: int):
        self.vectors, self.slots = vectors, Slots(slots)

    def of(self, text: str | None) -> np.ndarray:
        core, shape = self.slots.of(text)
        if not len(core):
            return np.zeros(2 * self.vectors.shape[1] + 1)
        return np.concatenate([self.vectors[core].mean(axis=0), self.vectors[shape].mean(axis=0), [np.log1p(len(core)) / 10]]).astype(float)


@dataclass
class Network:
    """tanh layer, then a logistic output divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -35, 35)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Network:
        """Adam on four fifths of the rows; the rest chooses the temperature by its log-loss."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        aside = order[: len(x) // 5]
        train = order[len(x) // 5 :]
        net = cls(x[train].mean(0), x[train].std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
        state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("w1", "b1", "w2", "b2")}
        step = 0
        for _ in range(epochs):
            rng.shuffle(train)
            for start in range(0, len(train), 128):
                at = train[start : start + 128]
                u = (x[at] - net.mean) / net.scale
                h = np.tanh(u @ net.w1 + net.b1)
                g = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -35, 35))) - y[at]) / len(at)
                back = np.outer(g, net.w2) * (1 - h * h)
                step += 1
                for k, grad in (("w1", u.T @ back + decay * net.w1), ("b1", back.sum(0)), ("w2", h.T @ g + decay * net.w2), ("b2", g.sum())):
                    m, v = state[k]
                    m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                    state[k] = m, v
                    setattr(net, k, getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        if len(aside):
            z = net.logit(x[aside])

            def loss(t: float) -> float:
                return float(np.mean(np.logaddexp(0, z / t) - y[aside] * z / t))

            net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return net


@dataclass
class QualityModel:
    indexing: Indexing
    vectors: np.ndarray
    network: Network | None

    def scorer(self):
        pool = Pool(self.vectors, self.indexing.slots)
        return lambda text: float(self.network.probability(pool.of(text)[None])[0]) if self.network else 0.5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, indexing: Indexing = Indexing()) -> QualityModel:
    """Word vectors from all of ``docs``; the network from at most ``max_rows`` labelled rows.

    Null keys or labels don't count. With labels of fewer than two classes the model scores 0.5.
    """
    vectors = word_vectors(docs, text, indexing)
    sample = F.broadcast(bounded_labels(labels, key, label, max_rows))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(sample, "_key").select("_key", "_text", "_label")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(shared.value, indexing.slots)
        for batch in stream:
            rows = [pool.of(t.as_py()).astype("<f4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["_key", "_label", "vector"])

    rows = sorted(tuple(r) for r in texts.mapInArrow(lean(run), T.StructType([texts.schema["_key"], T.StructField("_label", T.IntegerType()), T.StructField("vector", T.BinaryType())])).collect())
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return QualityModel(indexing, vectors, None)
    return QualityModel(indexing, vectors, Network.fit(np.stack([np.frombuffer(r[2], "<f4") for r in rows]).astype(float), y))


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the calibrated probability of label 1, to every row; null and empty texts get that of a zero vector.

    Reads nothing but the text. Other columns stay; a column called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_score(docs, text, out, lambda: shared.value.scorer())
