"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.session import materialize  # noqa: F401  the operators take it from here

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs give equal outputs, near inputs give far ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= _GOLD
    x ^= x >> np.uint64(32)
    return x


def hash_bytes(data: bytes) -> int:
    """A stable 64-bit hash of a short byte string."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class WordHashes(dict):
    """word bytes -> 64-bit hash, computed once for a word; emptied when it grows past ``limit``."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = hash_bytes(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words, one text after the other, and each text's number of words.

    Words are runs of bytes other than ASCII white space; A-Z is lower-cased. A null has none. A word's hash
    is the mixed sum of its 8-byte pieces, each mixed with its place in the word.
    """
    texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    total = int(offsets[-1] - offsets[0]) if len(texts) else 0
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.zeros(total + 8, np.uint8)  # the last piece is read past its end
    data[:total] = np.frombuffer(texts.buffers()[2], np.uint8, total, int(offsets[0]))
    data += ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
    inside = np.zeros(total + 2, bool)
    inside[1:-1] = (data[:total] != 32) & (data[:total] - np.uint8(9) > 4)
    bounds = offsets - offsets[0]
    inner = bounds[1:-1]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = inner[(inner > 0) & (inner < total)]
    begins[cut] |= inside[cut + 1]
    stops[cut - 1] |= inside[cut]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    lengths = ends - starts
    pieces = (lengths + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(starts, pieces) + 8 * place
    spare = 8 * np.maximum(at + 8 - np.repeat(ends, pieces), 0).astype(np.uint64)
    piece = np.ndarray((total,), "<u8", data, 0, (1,))[at] << spare
    tags = mix64(np.arange(1, int(pieces.max()) + 1, dtype=np.uint64) * _GOLD)
    value = np.add.reduceat(mix64(piece + tags[place]), first)
    return mix64(value ^ lengths.astype(np.uint64) * _GOLD), counts


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` consecutive words, one text after the other, and their number.

    With fewer words, the hash of all of them together; a text without words has none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    reach = np.minimum(counts, width)
    out = np.zeros(len(words), np.uint64)  # from every word on, as far as its text's shingles reach
    own = np.repeat(reach, counts)
    short = np.flatnonzero(own < width)
    for k in range(min(width, len(words))):
        more = mix64(out[: len(words) - k] * _GOLD + words[k:] + np.uint64(k + 1))
        over = short[own[short] <= k]
        over = over[over < len(more)]
        more[over] = out[over]
        out[: len(more)] = more
    out[short] += own[short].astype(np.uint64)
    left = np.repeat(ends, counts) - np.arange(len(words))
    out = out[left >= own]
    sizes = counts - reach + (counts > 0)
    stops = np.cumsum(sizes)
    for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[(stops - sizes)[sizes > 0]] = True
    return out[new], np.diff(np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], stops])])


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def fold_of_id(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns other than the named ones, whose letter case doesn't count."""
    replaced = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in replaced]


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def even_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """Integers, one for each partition, that ``repartition(parts, column)`` deals to it: a hash of 0 .. parts - 1 would leave gaps.

    At most ``parts`` rows come to the driver.
    """
    tries = int(parts * (np.log(parts) + 12))
    dealt = spark.range(tries).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("part")).agg(F.min("key").alias("key"))
    keys = np.arange(parts, dtype=np.int32)  # a partition that no number hits has its own number, which another one takes
    for part, key in dealt.collect():
        keys[part] = key
    return keys


_held: tuple | None = None


def worker_memory(name: tuple, make: Callable):
    """What a Python worker keeps from one task to the next: one thing, of whichever operator asked last."""
    global _held
    if _held is None or _held[0] != name:
        _held = None  # the one before goes first
        _held = (name, make())
    return _held[1]


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, after which its worker gives the memory that it no longer uses back to the system.

    Unless it ``keeps`` the worker's memory, what other work left there goes before it begins: Spark uses a worker for many jobs.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _held
        if not keeps:
            _held = None
        yield from work(stream)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


def small(stream: Iterator[pa.RecordBatch], rows: int = 1024, heavy: int | None = None, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a task holds and sends at once stays small.

    A batch ends also where its texts, in column ``heavy``, would pass ``most`` bytes; a longer text goes alone.
    """
    for batch in stream:
        if heavy is None:
            cuts = [*range(0, batch.num_rows, rows), batch.num_rows]
        else:
            held = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(heavy)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0]
            while cuts[-1] < batch.num_rows:
                before = held[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(min(cuts[-1] + rows, max(cuts[-1] + 1, int(np.searchsorted(held, before + most, "right")))))
            cuts[-1] = min(cuts[-1], batch.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
