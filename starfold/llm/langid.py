"""Language ID: each document as a mixture of languages, by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.common import lean, mix64, others, small


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def grams(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of a text's letter trigrams; everything else counts as one kind of break."""
    codes = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0)
    codes = np.concatenate([[np.uint64(0)], codes, [np.uint64(0)]])
    packed = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    slots = (mix64(packed[codes[1:-1] > 0]) >> np.uint64(64 - bits)).astype(np.int64)
    if len(slots) * 8 < 1 << bits:
        found, counts = np.unique(slots, return_counts=True)
        return found, counts.astype(float)
    counts = np.bincount(slots, minlength=1 << bits)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


@dataclass(frozen=True)
class LanguageModel:
    """``likelihood[slot, language]``, each column a smoothed distribution over trigram slots."""

    languages: tuple[str, ...]
    likelihood: np.ndarray
    bits: int
    penalty: float = 3.0
    iterations: int = 25

    def mixture(self, slots: np.ndarray, counts: np.ndarray, among: list[int]) -> tuple[np.ndarray, float]:
        """Proportions of the languages in ``among``, and the log-likelihood that they give."""
        p = self.likelihood[slots][:, among]
        total = counts.sum()
        share = np.full(len(among), 1 / len(among))
        for _ in range(self.iterations if len(among) > 1 else 1):
            joint = p * share
            new = counts @ (joint / joint.sum(axis=1, keepdims=True)) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(counts @ np.log(p @ share))

    def languages_of(self, text: str | None) -> list[tuple[str, float]]:
        """The languages chosen and their proportions, largest first; empty without a letter.

        All languages are mixed first. Then, from the largest down, a language joins as
        long as it raises the log-likelihood by more than ``penalty`` * log(trigrams).
        """
        slots, counts = grams(text, self.bits)
        if not len(slots) or not self.languages:
            return []
        whole, _ = self.mixture(slots, counts, list(range(len(self.languages))))
        order = np.argsort(-whole, kind="stable").tolist()
        chosen, (share, fit) = order[:1], self.mixture(slots, counts, order[:1])
        for more in order[1:]:
            if whole[more] < 0.01:
                break
            wider, better = self.mixture(slots, counts, [*chosen, more])
            if better - fit <= self.penalty * np.log(counts.sum() + 1):
                break
            chosen, share, fit = [*chosen, more], wider, better
        return sorted(((self.languages[c], float(s)) for c, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows_per_language: int = 3000, bits: int = 14, smoothing: float = 0.3) -> LanguageModel:
    """Trigram distributions from about ``rows_per_language`` labelled documents of each language.

    The rows of smallest hash of (key, text length) are taken, in proportion to how many a language has,
    so the sample's size doesn't grow with the table. Null languages and texts don't count.
    """
    held = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"), F.col(key).alias("_key"))
    sizes = {r["_lang"]: r["count"] for r in held.groupBy("_lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((1 << bits, 0)), bits)
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, rows_per_language / n))])
    draw = F.pmod(F.xxhash64("_key", F.length("_text")), F.lit(1_000_000)) / 1_000_000
    sample = held.filter(draw < share[F.col("_lang")]).select("_lang", "_text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in stream:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                slots, counts = grams(value.as_py(), bits)
                np.add.at(sums.setdefault(name, np.zeros(1 << bits)), slots, counts)
        for name, values in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "counts": pa.array([values.astype("<f4").tobytes()], pa.binary())})

    table = np.zeros((1 << bits, len(languages)))
    for name, counts in sample.mapInArrow(lean(run), "lang string, counts binary").toLocalIterator():
        table[:, languages.index(name)] += np.frombuffer(counts, "<f4")
    table += smoothing
    return LanguageModel(languages, table / table.sum(axis=0), bits)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "languages") -> DataFrame:
    """Add ``out``: array of (lang, share), the chosen languages of each whole text, largest first.

    Null texts and texts without a letter have an empty array. Reads nothing but the
    text. Other columns stay; a column called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = others(docs, out)
    pair = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(pair))])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.languages_of
        for batch in small(stream):
            texts = batch.column(batch.schema.get_field_index(text))
            found = [[{"lang": name, "share": s} for name, s in find(t.as_py())] for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(found, kind)], names=[*keep, out])

    return docs.mapInArrow(lean(run), schema)


def first_language(found) -> tuple:
    """(lang_pred, score) columns of an array made by ``identify``: ``und`` and 0 if it is empty."""
    return F.coalesce(F.get(found, F.lit(0))["lang"], F.lit("und")).alias("lang_pred"), F.coalesce(F.get(found, F.lit(0))["share"], F.lit(0.0)).alias("score")
