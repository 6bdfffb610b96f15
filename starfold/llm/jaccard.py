"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles fall into size bands. Two sets with Jaccard similarity of at
least t = num/den differ in at most k elements, where k follows from the band. The
element domain is cut into n1 parts by hash, and each part into n2 smaller ones; one of
the n1 parts holds at most k2 differences, so that some n2 - k2 of its smaller parts hold
equal elements in both sets. A set's signatures are the hashes of its elements in every
such choice: linked sets share one. Sets that share a signature are compared by small
histograms of their elements, whose distance is never more than the number of differing
elements; pairs within the threshold by that bound form families, and each family is
verified exactly, by intersection sizes from its own inverted lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import even_keys, lean, materialize, mix64, shingle_sets, small
from starfold.llm.components import connected_components


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least ``num`` / ``den``."""

    num: int
    den: int

    def band(self, size: int) -> int:
        """Bands grow by den/num: a set's partners lie in its own band or in one beside it."""
        low, band = 1, 0
        while (high := max(low + 1, low * self.den // self.num + 1)) <= size:
            low, band = high, band + 1
        return band

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        """``band`` of every size."""
        lows = [1]
        while lows[-1] <= sizes.max(initial=0):
            lows.append(self.largest(len(lows) - 1) + 1)
        return np.maximum(np.searchsorted(lows, sizes, "right") - 1, 0)

    def largest(self, band: int) -> int:
        """The largest size in a band."""
        low = 1
        for _ in range(band + 1):
            low = max(low + 1, low * self.den // self.num + 1)
        return low - 1

    def differences(self, band: int) -> int:
        """Most differing elements of a linked pair whose smaller set is in the band."""
        small = self.largest(band)
        return (self.den - self.num) * (small + small * self.den // self.num) // (self.den + self.num)

    def linked(self, both, left, right):
        """Whether sets of sizes ``left`` and ``right`` with ``both`` elements in common link."""
        return self.den * both >= self.num * (left + right - both)

    def possible(self, apart, left, right):
        """Whether sets of these sizes can link if at least ``apart`` elements are in one of them only."""
        return (self.den + self.num) * apart <= (self.den - self.num) * (left + right)


#: A set may leave out signatures of no elements, as long as it has at most this many parts with such ones.
SPARE_PARTS = 2


@lru_cache(maxsize=None)
def scheme(differences: int, size: int, effort: float) -> tuple[int, int, int]:
    """(n1, n2, k2): of the schemes with at most effort * (k + 1) + 6 signatures, the one with most elements in a signature."""
    best, found = -1.0, (differences + 1, 1, 0)
    for k2 in range(min(differences, 4) + 1):
        n1 = -(-(differences + 1) // (k2 + 1))
        for n2 in range(k2 + 1, k2 + 7):
            if n1 * comb(n2, k2) <= effort * (differences + 1) + 6:
                strength = size / n1 * (n2 - k2) / n2
                if strength > best + 1e-9:
                    best, found = strength, (n1, n2, k2)
    return found


@lru_cache(maxsize=None)
def plan(threshold: Threshold, band: int, effort: float) -> tuple[int, int, int] | None:
    """The band's scheme with its spare parts; None where only equal sets can link."""
    k = threshold.differences(band)
    if k == 0:
        return None
    n1, n2, k2 = scheme(k, threshold.largest(band), effort)
    return n1 + (SPARE_PARTS if n1 > SPARE_PARTS else 0), n2, k2


def signatures_of(elements: np.ndarray, sizes: np.ndarray, threshold: Threshold, effort: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places): hashes shared by every pair of linked, unequal sets, each with its set's place in ``sizes``.

    ``elements`` holds the sets, of distinct hashes, one after the other. A set signs for its own band as the smaller
    one of a pair, and for the band below as the larger one. Sets of a band are signed together.
    """
    own = threshold.bands(sizes)
    order = np.argsort(own, kind="stable")
    own, held = own[order], sizes[order]
    starts = np.concatenate([[0], np.cumsum(held)])
    elements = elements[np.repeat((np.cumsum(sizes) - sizes)[order] - starts[:-1], held) + np.arange(starts[-1])]
    signs, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for band in sorted({*own.tolist()} | {*(own[own > 0] - 1).tolist()}):
        if (shape := plan(threshold, band, effort)) is None:
            continue
        n1, n2, k2 = shape
        a, b = np.searchsorted(own, band), np.searchsorted(own, band + 1, "right")
        salted = mix64(elements[starts[a] : starts[b]] ^ np.uint64(band * 2654435761 + 97))
        small = (salted % np.uint64(n1 * n2)).astype(np.int64) + np.repeat(np.arange(b - a) * (n1 * n2), held[a:b])
        sums = np.zeros((b - a) * n1 * n2, np.uint64)
        np.add.at(sums, small, mix64(salted))
        sums, empty = sums.reshape(-1, n1, n2), np.bincount(small, minlength=len(sums)).reshape(-1, n1, n2) == 0
        mixed = mix64(sums + np.arange(n2, dtype=np.uint64))
        choices = np.array(list(combinations(range(n2), n2 - k2)))
        tagged = np.zeros((b - a, n1, len(choices)), np.uint64)
        bare = np.ones(tagged.shape, bool)
        for part in choices.T:
            tagged += mixed[:, :, part]
            bare &= empty[:, :, part]
        found = mix64(tagged + np.arange(n1 * len(choices), dtype=np.uint64).reshape(n1, -1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
        spare = SPARE_PARTS if n1 > SPARE_PARTS and shape[0] != scheme(threshold.differences(band), threshold.largest(band), effort)[0] else 0
        kept = ~bare | (bare.any(axis=2).sum(axis=1) > spare)[:, None, None]
        signs.append(found[kept])
        places.append(np.repeat(order[a:b], kept.sum(axis=(1, 2))))
    return np.concatenate(signs), np.concatenate(places)


def signatures(elements: np.ndarray, threshold: Threshold, effort: float = 1.0) -> np.ndarray:
    """The distinct signatures of one set."""
    return np.unique(signatures_of(elements, np.array([len(elements)]), threshold, effort)[0])


def histogram(elements: np.ndarray) -> bytes:
    """Counts of elements by their leading bits, four bits each: as many buckets, a power of two, as elements at least.

    Counts stop at 15; the distance of two such histograms is still at most the number of differing elements.
    """
    bits = max(4, (len(elements) - 1).bit_length())
    counts = np.minimum(np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def _counts(packed: list[bytes]) -> np.ndarray:
    """The histograms as rows, all folded to the buckets of the shortest."""
    width = min(map(len, packed))
    rows = np.empty((len(packed), 2 * width), np.int16)
    for i, p in enumerate(packed):
        both = np.frombuffer(p, np.uint8)
        counts = np.empty(2 * len(both), np.int16)
        counts[::2], counts[1::2] = both & 15, both >> 4
        rows[i] = counts.reshape(2 * width, -1).sum(axis=1)
    return rows


def possible_forest(packed: list[bytes], sizes: np.ndarray, threshold: Threshold) -> list[tuple[int, int]]:
    """Pairs of places that span the components of all pairs whose histograms allow a link."""
    counts = _counts(packed)
    left = np.arange(len(packed))
    found, todo = [], []
    while len(left):
        if not todo:
            todo.append(int(left[0]))
            left = left[1:]
        x = todo.pop()
        near = np.zeros(len(left), bool)
        step = max(1, (1 << 22) // counts.shape[1])
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            near[at : at + step] = threshold.possible(np.abs(counts[rows] - counts[x]).sum(axis=1), sizes[x], sizes[rows])
        reached = left[near].tolist()
        found += [(x, y) for y in reached]
        todo += reached
        left = left[~near]
    return found


def linked_within(keys: np.ndarray, sizes: np.ndarray, elements: np.ndarray, threshold: Threshold, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join a family's sets, by exact intersection sizes; of each component only a spanning tree.

    ``elements`` holds the sets one after the other. With ``left``, only pairs of a set in it and one out of it are compared.
    """
    n = len(keys)
    owner = np.repeat(np.arange(n), sizes)
    _, element = np.unique(elements, return_inverse=True)
    order = np.argsort(element, kind="stable")
    counts = np.bincount(element)
    begins = np.cumsum(counts) - counts
    posting = owner[order]
    ends = np.cumsum(sizes)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for x in range(n) if left is None else np.flatnonzero(left):
        own = element[ends[x] - sizes[x] : ends[x]]
        own = own[counts[own] > 1]
        if not len(own):
            continue
        lengths = counts[own]
        stops = np.cumsum(lengths)
        places = np.repeat(begins[own] - (stops - lengths), lengths) + np.arange(stops[-1])
        both = np.bincount(posting[places], minlength=n)
        good = threshold.linked(both, sizes[x], sizes) & (both > 0)
        if left is None:
            good[: x + 1] = False
        else:
            good &= ~left
        for y in np.flatnonzero(good):
            a, b = root(x), root(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(keys[x]), int(keys[y])))
    return links


#: Elements of a family that are verified in one task; a larger family goes in blocks, each pair of blocks by itself.
BLOCK_ELEMENTS = 3_000_000
#: Different sets of one signature whose histograms one task compares; more of them go in blocks, each pair of blocks by itself.
BLOCK_SETS = 8192


#: Sets whose signatures are packed together; their places among them take 16 bits.
SIGNED_ROWS = 512


def packed_signatures(signs: np.ndarray, places: np.ndarray, names: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """(part, blob) for each part: signatures by remainder; of the rest 32 bits are kept, and a clash costs one comparison."""
    part = (signs % np.uint64(parts)).astype(np.int32)
    short = (signs // np.uint64(parts)).astype(np.uint32)
    order = np.argsort(places.astype(np.uint16), kind="stable")  # 16 bits sort by radix
    order = order[np.argsort(part.astype(np.uint16)[order] if parts <= 1 << 16 else part[order], kind="stable")]
    part, short, place = part[order], short[order], places[order]
    first = np.diff(part, prepend=-1) != 0
    new = first | (np.diff(place, prepend=-1) != 0)
    rank = np.cumsum(new) - 1
    cuts = np.append(np.flatnonzero(first), len(part))
    used = names[place[new]]
    bounds = np.append(rank[cuts[:-1]], len(used))
    at = (rank - np.repeat(bounds[:-1], np.diff(cuts))).astype(np.uint16)
    each = zip(cuts[:-1].tolist(), cuts[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
    return part[cuts[:-1]], [np.uint32(b - a).tobytes() + short[a:b].tobytes() + used[c:d].tobytes() + at[a:b].tobytes() for a, b, c, d in each]


def unpacked_signatures(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, sets) of a blob."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    used = (len(blob) - 4 - 6 * n) // 8
    sets = np.frombuffer(blob, np.int64, used, 4 + 4 * n)
    return np.frombuffer(blob, np.uint32, n, 4), sets[np.frombuffer(blob, np.uint16, n, 4 + 4 * n + 8 * used)]


def _bursts(found: Iterator[tuple[int, np.ndarray]], rows: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Lists of groups with about so many sets."""
    some, held = [], 0
    for group in found:
        some.append(group)
        held += len(group[1])
        if held >= rows:
            yield some
            some, held = [], 0
    if some:
        yield some


def meetings(signs: np.ndarray, sets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(name, sets) of every different group of sets that share a signature."""
    order = np.argsort(signs)
    signs = signs[order]
    alone = np.ones(len(signs) + 1, bool)
    alone[1:-1] = signs[1:] != signs[:-1]
    shared = ~(alone[1:] & alone[:-1])  # most signatures are of one set
    signs, sets = signs[shared], sets[order[shared]]
    order = np.lexsort((sets, signs))
    signs, sets = signs[order], sets[order]
    new = np.ones(len(signs), bool)
    new[1:] = (signs[1:] != signs[:-1]) | (sets[1:] != sets[:-1])
    signs, sets = signs[new], sets[new]
    starts = np.flatnonzero(np.diff(signs, prepend=~signs[:1]))
    ends = np.append(starts[1:], len(signs))
    sizes = ends - starts
    named = set()
    whole = (sizes > 1) & (sizes <= BLOCK_SETS)
    names = set_keys(sets[np.repeat(whole, sizes)].view(np.uint64), sizes[whole])
    names, first = np.unique(names, return_index=True)
    for name, a, b in zip(names.tolist(), starts[whole][first].tolist(), ends[whole][first].tolist(), strict=True):
        named.add(name)
        yield name, sets[a:b]
    large = sizes > BLOCK_SETS
    for a, b in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        blocks = [sets[k : min(k + BLOCK_SETS, b)] for k in range(a, b, BLOCK_SETS)]
        for i in range(len(blocks)):
            for j in range(i + 1, len(blocks)):
                members = np.concatenate([blocks[i], blocks[j]])
                name = set_key(members.view(np.uint64))
                if name not in named:
                    named.add(name)
                    yield name, members


#: Bytes of text whose signatures a task sorts in memory.
PART_BYTES = 4 << 20


def _parts(rows: DataFrame) -> int:
    """As many parts as the session shuffles to, and more where the texts ask for it."""
    own = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(own, -(-size // PART_BYTES))


def join_components(docs: DataFrame, threshold: Threshold, width: int, key: str = "doc_id", text: str = "text", effort: float = 1.5) -> DataFrame:
    """(key, n_shingles, component_id) for every row: the smallest key reachable by links.

    A row's set holds the distinct ``width``-word shingles of its whole text; with fewer words,
    the whole sequence. Rows with null or empty texts, or without words, have the set size 0 and
    link with nothing. Equal sets link and are handled as one, so copies cost nothing and repeated
    rows share a component. A row with a null key is returned with its set size and a null component.
    The key is a long; other columns aren't read. Of linked, unequal sets at least one signature is
    equal; no signature, family or pair is capped, and large families are verified in blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    parts = _parts(rows)
    keys = even_keys(spark, parts)

    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small(stream, SIGNED_ROWS, heavy=1):
            if len(seen) > 500_000:
                seen.clear()
            elements, sizes = shingle_sets(batch.column(1), width)
            names = set_keys(elements, sizes)
            ends = np.cumsum(sizes)
            shapes: list[bytes | None] = [None] * batch.num_rows
            for i, name in enumerate(names.tolist()):
                if sizes[i] and name not in seen:
                    seen.add(name)
                    shapes[i] = histogram(elements[ends[i] - sizes[i] : ends[i]])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(keys[np.arange(n) % parts]), batch.column(0), pa.array(names), pa.array(sizes), pa.array(shapes, pa.binary())], names=["part", "doc", "set", "size", "data"])
            fresh = np.array([shape is not None for shape in shapes], bool)
            if fresh.any():
                signs, places = signatures_of(elements[np.repeat(fresh, sizes)], sizes[fresh], threshold, effort)
                part, blobs = packed_signatures(signs, places, names[fresh], parts)
                empty = pa.nulls(len(blobs), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), empty, empty, empty, pa.array(blobs, pa.binary())], names=["part", "doc", "set", "size", "data"])

    def meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, names = [], []
        for batch in stream:
            packed = pa.compute.is_null(batch.column(3))
            kept = batch.filter(pa.compute.invert(packed))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.nulls(kept.num_rows, pa.int64())], names=["doc", "set", "size", "data", "meeting"])
            for blob in batch.filter(packed).column(4):
                some, sets = unpacked_signatures(blob.as_buffer())
                signs.append(some)
                names.append(sets)
        if not signs:
            return
        sign, name = np.concatenate(signs), np.concatenate(names)
        del signs, names
        for found in _bursts(meetings(sign, name), 65536):
            members = np.concatenate([m for _, m in found])
            empty = pa.nulls(len(members), pa.int64())
            meeting = np.repeat(np.array([n for n, _ in found], np.int64), [len(m) for _, m in found])
            yield pa.RecordBatch.from_arrays([empty, pa.array(members), empty, pa.nulls(len(members), pa.binary()), pa.array(meeting)], names=["doc", "set", "size", "data", "meeting"])

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Meetings come one after the other; only one is held at a time."""
        held: list[tuple[int, int, bytes]] = []
        now = None

        links: list[tuple[int, int]] = []

        def look() -> None:
            pairs = possible_forest([h[2] for h in held], np.array([h[1] for h in held]), threshold)
            links.extend((held[x][0], held[y][0]) for x, y in pairs)
            held.clear()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
            links.clear()
            return made

        for batch in small(stream):
            for meeting, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if meeting != now and held:
                    look()
                now = meeting
                held.append(tuple(row))
            if len(links) > 65536:
                yield out()
        if held:
            look()
        yield out()

    signed = rows.mapInArrow(lean(sign), "part int, doc long, set long, size long, data binary")
    met = materialize(signed.repartition(parts, "part").mapInArrow(lean(meet), "doc long, set long, size long, data binary, meeting long"))
    own = met.filter("meeting is null").select("doc", "set", "size")
    sets = own.filter("size > 0 and doc is not null").groupBy("set").agg(F.min("doc").alias("doc"), F.first("size").alias("size"))
    shapes = met.filter("meeting is null and data is not null").groupBy("set").agg(F.first("size").alias("size"), F.first("data").alias("data"))
    together = met.filter("meeting is not null").select("meeting", "set").distinct().join(shapes, "set").select("meeting", "set", "size", "data")
    near = together.repartition(parts, "meeting").sortWithinPartitions("meeting").mapInArrow(lean(compare), "a long, b long")
    families = materialize(connected_components(near, "a", "b"))
    members = materialize(families.select(F.col("node").alias("set"), F.col("component").alias("family")).join(sets, "set"))
    blocks = members.groupBy("family").agg(F.ceil(F.sum("size") / BLOCK_ELEMENTS).cast("int").alias("blocks"))

    def reread(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(stream, heavy=3):
            found, sizes = shingle_sets(batch.column(3), width)
            same = set_keys(found, sizes) == batch.column(0).to_numpy()  # a repeated key can have another text
            kept = batch.filter(pa.array(same))
            packed = [e.tobytes() for e, good in zip(np.split(found, np.cumsum(sizes)[:-1]), same.tolist(), strict=True) if good]
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(packed, pa.binary())], names=["set", "family", "blocks", "elements"])

    wanted = members.join(blocks, "family").select("set", "family", "blocks", "doc")
    texts = rows.join(wanted.hint("shuffle_hash"), "doc").select("set", "family", "blocks", "text")
    dealt = texts.mapInArrow(lean(reread), "set long, family long, blocks int, elements binary")
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "set", "elements")

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, at = np.unique(table["set"].to_numpy(), return_index=True)
        packed = [np.frombuffer(table["elements"][int(i)].as_buffer(), np.uint64) for i in at]
        sizes = np.array([len(p) for p in packed])
        left = table["mine"].to_numpy()[at] == table["i"][0].as_py() if table["i"][0].as_py() != table["j"][0].as_py() else None
        links = linked_within(keys, sizes, np.concatenate(packed), threshold, left)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    links = dealt.groupBy("family", "i", "j").applyInArrow(verify, "a long, b long")
    joined = connected_components(links, "a", "b")
    group = sets.join(joined.withColumnsRenamed({"node": "set", "component": "group"}), "set", "left").select("set", "doc", F.coalesce("group", "set").alias("group"))
    least = group.groupBy("group").agg(F.min("doc").alias("least"))
    found = group.join(least, "group").select("set", "least")
    return own.join(found, "set", "left").select(
        F.col("doc").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.when(F.col("doc").isNotNull(), F.col("least"))).otherwise(F.col("doc")).alias("component_id")
    )


def set_keys(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; ``elements`` holds the sets one after the other. The empty set has 0."""
    out = np.zeros(len(sizes), np.int64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        mixed = mix64(elements)
        starts = (np.cumsum(sizes) - sizes)[filled]
        of = np.stack([np.add.reduceat(mixed, starts), np.bitwise_xor.reduceat(mixed, starts), sizes[filled].astype(np.uint64)], axis=1)
        out[filled] = mix64(of * np.array([1, 31, 961], np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
    return out


def set_key(elements: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(set_keys(elements, np.array([len(elements)]))[0])
