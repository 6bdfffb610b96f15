"""Byte-level BPE: encoding and decoding against a fixed rank vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern. Tier one looks a whole
pre-token up in a minimal perfect hash over the vocabulary. What isn't there goes to
tier two, which merges a linked list of bytes with a heap of (rank, place) pairs.
Each distinct pre-token is resolved once per worker and remembered, within a bound.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from starfold.llm.common import lean, others

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, rank) pairs of a rank file: base64 of the token, a space, the rank."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, lines)]


class MinimalPerfectHash:
    """Hash and displace: n keys fill exactly n slots; a lookup reads one displacement and one slot.

    Keys fall into buckets by half of a 128-bit hash. Buckets are placed from the
    largest down, each with the first displacement that leaves its keys on free slots;
    a bucket of one key names its slot directly, as a negative displacement.
    """

    def __init__(self, items: list[tuple[bytes, int]]):
        self.n = len(items)
        self.buckets = max(1, self.n // 4)
        self.displacement = [0] * self.buckets
        self.keys: list[bytes] = [b""] * self.n
        self.values: list[int] = [-1] * self.n
        groups: dict[int, list[tuple[int, bytes, int]]] = {}
        for key, value in items:
            whole = xxhash.xxh3_128_intdigest(key)
            groups.setdefault((whole & _MASK) % self.buckets, []).append((whole >> 64, key, value))
        free = np.ones(self.n, bool)
        singles = []
        tries = np.arange(1, 1025, dtype=np.uint64)
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            base = 0
            while True:
                slots = np.stack([self._slots(np.uint64(h), tries + np.uint64(base)) for h, _, _ in members])
                good = free[slots].all(axis=0)
                ordered = np.sort(slots, axis=0)
                good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                if good.any():
                    at = int(np.argmax(good))
                    break
                base += len(tries)
            self.displacement[bucket] = int(tries[at]) + base
            for slot, (_, key, value) in zip(slots[:, at].tolist(), members, strict=True):
                free[slot], self.keys[slot], self.values[slot] = False, key, value
        for slot, (bucket, (_, key, value)) in zip(np.flatnonzero(free).tolist(), singles, strict=True):
            self.displacement[bucket], self.keys[slot], self.values[slot] = -1 - slot, key, value

    def _slots(self, high: np.uint64, displacements: np.ndarray) -> np.ndarray:
        x = (high ^ (displacements * np.uint64(_STEP))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int:
        """The key's value, or -1 if it isn't one of the keys."""
        whole = xxhash.xxh3_128_intdigest(key)
        d = self.displacement[(whole & _MASK) % self.buckets]
        if d < 0:
            slot = -1 - d
        else:
            slot = ((((whole >> 64) ^ (d * _STEP & _MASK)) * 0xD6E8FEB86659FD93 & _MASK) >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """Ids of a piece that isn't a token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts at each place; 0 once the part is swallowed
    before = list(range(-1, n - 1))
    get = rank_of.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        middle = end[left]
        if not middle or middle >= n or middle >= stop or end[middle] != stop:
            continue  # one of its parts has changed since
        end[left], end[middle] = stop, 0
        if stop < n:
            before[stop] = left
            if (r := get(piece[left : end[stop]])) is not None:
                heapq.heappush(heap, (r, left, end[stop]))
        if (p := before[left]) >= 0 and (r := get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    ids, at = [], 0
    while at < n:
        ids.append(rank_of[piece[at : end[at]]])
        at = end[at]
    return ids


class Vocabulary:
    """A rank vocabulary with its pattern; small enough to broadcast, its size is fixed by the file."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.pattern = pattern
        self.table = MinimalPerfectHash(ranks)
        self._ready = None

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        return cls(read_ranks(path), pattern)

    def __getstate__(self):
        return {"pattern": self.pattern, "table": self.table, "_ready": None}

    def encoder(self) -> Encoder:
        if self._ready is None:
            self._ready = Encoder(self)
        return self._ready


class _Remembered(dict):
    """A bounded memory of two generations: what is asked for again outlives the rest.

    ``limit`` entries fill a generation; then it becomes the old one, and the old one goes.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Packed little-endian ids of texts. ``limit`` bounds what is remembered of pre-tokens and of pieces of text."""

    _odd_space = re.compile(r" (?=\s|\Z)")
    _cut = re.compile(r"(?= \S)")

    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000):
        self.table = vocabulary.table
        self.rank_of = dict(zip(self.table.keys, self.table.values, strict=True))
        self.split = regex.compile(vocabulary.pattern).findall
        self.known = _Remembered(self._pretoken, limit)
        self.spaced = _Remembered(lambda piece: self._piece(" " + piece), limit // 2)
        self.plain = _Remembered(self._piece, limit // 8)
        size = max(self.table.values, default=-1) + 1
        tokens = [b""] * size
        for token, rank in zip(self.table.keys, self.table.values, strict=True):
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def _pretoken(self, token: str) -> bytes:
        data = token.encode("utf-8", "surrogatepass")
        whole = self.table.get(data)
        return array("I", [whole] if whole >= 0 else merge_bytes(data, self.rank_of)).tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.known[token] for token in self.split(piece)])

    def encode(self, text: str | None) -> bytes:
        """A space before a visible character always starts a pre-token, so a text falls apart there."""
        if not text:
            return b""
        if self._odd_space.search(text):
            return b"".join(map(self.plain.__getitem__, self._cut.split(text)))
        first, *rest = text.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


def _with_binary(df: DataFrame, column: str, out: str, make: callable) -> DataFrame:
    keep = others(df, out)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                values = [work(v) for v in part.column(part.schema.get_field_index(column)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.binary())], names=[*keep, out])

    return df.mapInArrow(lean(run), schema)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the whole text's ids as packed little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Special-token strings are ordinary text. Every
    other column stays as it is; a column called ``ids``, in any letter case, is replaced.
    Rows never meet, so ties, repeated rows and hot keys need no rule.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    return _with_binary(df, text, ids, lambda: shared.value.encoder().encode)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the packed ids stand for; null ids give no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        work = shared.value.encoder().decode
        return lambda packed: work(packed or b"")

    return _with_binary(df, ids, out, make)
