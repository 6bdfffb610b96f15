"""Suffix-array deduplication: removal of bytes covered by long strings that occur earlier.

Texts are UTF-8 bytes. A window is a string of ``length`` bytes; one that occurs earlier
(a smaller document, or an earlier place in it) is removed with all of its bytes.

Every window is led by the least hash of the short strings in it, its anchor, so that equal
windows have equal anchors at equal places. Windows in a row with one anchor form a run.
1. Runs are dealt by their anchor's hash. Of runs that are equal as a whole, all but the
   first go; runs with an anchor of their own stay. Each task sends one of its equal runs only.
2. What is left are different runs that share an anchor, mostly at the edges of passages.
   Their bytes from the anchor on are suffixes, ordered by deep-shallow sorting: multikey
   quicksort to a shallow depth, then blind tries for groups that agree that far. Common
   prefixes with the neighbours in that order say which windows agree to the right of the
   anchor; those among them that also agree to its left are equal.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import even_keys, lean, materialize, mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes, by doubling."""
    whole, size, out, done = _BYTE[data], 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = whole, size
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + whole[done : done + n]
                done += size
        if size * 2 > width:
            return out
        whole = whole[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + whole[size:]
        size *= 2


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or greatest (``pick``) of every ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return values if size == width else pick(values[: len(values) - (width - size)], values[width - size :])


class Runs:
    """The runs of one document: anchor hashes, anchor places, first and last window starts."""

    def __init__(self, data: np.ndarray, length: int, gram: int):
        span = length - gram + 1  # strings of ``gram`` bytes in a window
        hashes = mix64(rolling(data, gram))
        least = sliding(hashes, span, np.minimum)
        wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        self.place = np.flatnonzero(sliding(wide, span, np.maximum) == hashes)
        self.anchor = hashes[self.place]
        # where an anchor's windows begin and end: at those before and after it with a smaller hash
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        begin, end = np.concatenate([[0], change]), np.concatenate([change, [len(least)]])
        low = np.maximum(self.place - span + 1, 0)
        high = np.minimum(self.place, len(least) - 1)
        at = np.searchsorted(begin, low, "right") - 1
        wrong = least[low] != self.anchor  # then its windows begin with a later stretch
        while wrong.any():
            at[wrong] += 1
            wrong[wrong] = least[begin[at[wrong]]] != self.anchor[wrong]
        self.first = np.maximum(low, begin[at])
        self.last = np.minimum(high, end[at] - 1)
        # the content of a run, with its anchor's place in it
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix64(_BYTE[data].astype(np.uint64)) * powers(_BASE, len(data)), out=sums[1:])
        stop = self.last + length
        content = (sums[stop] - sums[self.first]) * powers(_INVERSE, len(data))[self.first]  # where it stands doesn't count
        self.content = mix64(content + mix64((stop - self.first).astype(np.uint64) * np.uint64(1 << 20) + (self.place - self.first).astype(np.uint64)))


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, from a table that grows as needed."""
    if len(_tables.get(base, ())) < n:
        _tables[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16) * 2, base, np.uint64)]))
    return _tables[base][:n]


def multikey_quicksort(keys: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """Groups, in order, of rows that agree in all columns of ``keys``; split column by column, three ways at a time.

    Each column is the next eight bytes of the strings as a big-endian number.
    """
    out: list[np.ndarray] = []
    todo = [(order, 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == keys.shape[1] or len(rows) == 1:
            out.append(rows)
            continue
        if len(rows) <= 16:  # too few for a pivot to pay
            by_key: dict[tuple, list[int]] = {}
            for i, key in zip(rows.tolist(), keys[rows].tolist(), strict=True):
                by_key.setdefault(tuple(key), []).append(i)
            out += [np.array(by_key[key]) for key in sorted(by_key)]
            continue
        column = keys[rows, depth]
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        less, more = rows[column < pivot], rows[column > pivot]
        if len(more):
            todo.append((more, depth))
        todo.append((rows[column == pivot], depth + 1))
        if len(less):
            todo.append((less, depth))
    return out


class BlindTrie:
    """Sorts strings with a long common prefix. Inner nodes keep a branching place only; a string is compared with one leaf.

    Leaves of equal strings are chained. Nodes are lists [place, {byte: child}]; leaves are [ids].
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [[0]]
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        node = self.root
        while len(node) == 2:  # blind descent: only the branching bytes are looked at
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        t = self.strings[node[0][0]]
        if s == t:
            node[0].append(i)
            return
        place = common_prefix(s, t)
        above, node = None, self.root
        while len(node) == 2 and node[0] < place:
            above, node = node, node[1][s[node[0]]]
        mine = s[place] if place < len(s) else -1
        if len(node) == 2 and node[0] == place:
            node[1][mine] = [[i]]
            return
        fork = [place, {mine: [[i]], (t[place] if place < len(t) else -1): node}]
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]]] = fork

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if len(node) == 1:
                out += node[0]
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def common_prefix(s: bytes, t: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(s), len(t))
    if s[:n] == t[:n]:
        return n
    x = int.from_bytes(s[:n], "big") ^ int.from_bytes(t[:n], "big")
    return n - (x.bit_length() + 7) // 8


SHALLOW = 48


def deep_shallow_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the strings, and the common prefix of each with the one before it in that order."""
    width = SHALLOW // 8
    head = np.frombuffer(b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings]), ">u8").reshape(len(strings), width).astype(np.uint64)
    order: list[int] = []
    for group in multikey_quicksort(head, np.arange(len(strings))):
        if len(group) == 1:
            order.append(int(group[0]))
        else:
            order += group[BlindTrie([strings[i] for i in group]).order()].tolist()
    common = np.zeros(len(strings), np.int64)
    for k in range(1, len(order)):
        common[k] = common_prefix(strings[order[k - 1]], strings[order[k]])
    return np.array(order, np.int64), common


#: Groups up to this size are compared by walking the suffix order; larger ones by reach.
SMALL_GROUP = 12

Row = tuple[int, int, int, int, int, bytes, int]


def windows_seen_before(rows: list[Row], length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(doc, tag, begin, end) of stretches covered by windows that an earlier row also has.

    Rows are runs (doc, place of the anchor, first, last, begin of bytes, bytes, tag); doc and tag name a document. A window is given
    by how far it reaches to the left of its anchor, ``reach``: rows that agree for ``length - reach``
    bytes from the anchor on stand together in suffix order, and those of them with equal bytes to
    the left have the same window. All rows are ordered at once; those of one anchor agree for
    ``gram`` bytes, so they are neighbours.
    """
    rows = list({(r[0], r[6], r[1]): r for r in rows}.values())
    order, common = deep_shallow_sort([r[5][r[1] - r[4] : r[1] - r[4] + length] for r in rows])
    starts = np.append(np.flatnonzero(common < gram), len(rows)).tolist()
    order, common = order.tolist(), common.tolist()
    out: list[tuple[int, int, int, int]] = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        group = [rows[i] for i in order[a:b]]
        if 1 < b - a <= SMALL_GROUP:
            out += _walk(group, common[a:b], length)
        elif b - a > 1:
            out += _by_reach(group, np.array(common[a:b]), length)
    return out


def _walk(group: list[Row], common: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Each row with those behind it in suffix order, as long as what they share to the right can still do."""
    left = [r[5][: r[1] - r[4]][::-1] for r in group]
    for i, (doc, place, first, last, _, _, tag) in enumerate(group):
        right = length
        for j in range(i + 1, len(group)):
            right = min(right, common[j])
            if right + place - first < length:
                break
            other = group[j]
            low = max(length - right, place - last, other[1] - other[3])
            high = min(place - first, other[1] - other[2])
            if low <= high and (high := min(high, common_prefix(left[i], left[j]))) >= low:
                later = max((doc, tag, place), (other[0], other[6], other[1]))
                yield later[0], later[1], later[2] - high, later[2] - low + length


def _by_reach(group: list[Row], common: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """For every reach, rows that agree to the right and to the left; all but the first have the window again."""
    docs, place, first, last, tags = (np.array([r[k] for r in group]) for k in (0, 1, 2, 3, 6))
    lowest, highest = place - last, place - first
    width = int(highest.max())
    left = np.zeros((len(group), max(width, 1)), np.uint8)  # bytes to the left of the anchor, nearest first
    for i, r in enumerate(group):
        before = np.frombuffer(r[5][: r[1] - r[4]], np.uint8)[::-1][:width]
        left[i, : len(before)] = before
    rank = np.empty(len(group), np.int64)
    rank[np.lexsort((place, tags, docs))] = np.arange(len(group))
    found = np.zeros((len(group), width + 1), bool)
    left_key = np.zeros(len(group), np.uint64)
    for reach in range(width + 1):
        if reach:
            left_key = mix64(left_key * np.uint64(31) + left[:, reach - 1] + np.uint64(1))
        at = np.flatnonzero((lowest <= reach) & (reach <= highest))
        if len(at) < 2:
            continue
        right_key = np.cumsum(common < length - reach).astype(np.uint64)
        at = at[np.argsort(rank[at])]
        name = mix64(right_key[at] * np.uint64(0x9E3779B97F4A7C15) ^ left_key[at])
        _, earliest, inverse = np.unique(name, return_index=True, return_inverse=True)
        found[at[earliest[inverse] != np.arange(len(at))], reach] = True
    for i in np.flatnonzero(found.any(axis=1)):
        edge = np.diff(np.concatenate([[0], found[i].astype(np.int8), [0]]))
        for low, high in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
            yield int(docs[i]), int(tags[i]), int(place[i] - high), int(place[i] - low + length)


#: Different runs of one anchor that are ordered in one task; those of an anchor with more are dealt by single windows.
ANCHOR_RUNS = 20_000

#: A document is a key and a tag: 0, or a digest of its text where rows repeat the key.
_RUN = [("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("place", "<u4"), ("before", "u1"), ("after", "u1")]
_CUT = [("doc", "<i8"), ("tag", "<i8"), ("begin", "<u4"), ("end", "<u4")]
_ASK = [("anchor", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("place", "<u4"), ("before", "u1"), ("after", "u1"), ("hot", "u1")]


def _columns(values: dict[str, np.ndarray], kind: list, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, packed columns) of the rows of each part; columns stand one after the other, which compresses better."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        yield int(part[rows[0]]), b"".join(values[n][rows].astype(t).tobytes() for n, t in kind)


def _unpacked(blobs: list[bytes], kind: list) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in kind)
    out: dict[str, list[np.ndarray]] = {n: [] for n, _ in kind}
    for blob in blobs:
        at, n = 0, len(blob) // width
        for name, t in kind:
            out[name].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {n: np.concatenate(v) if v else np.empty(0, t) for (n, t), v in zip(kind, out.values(), strict=True)}


def _earlier(runs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs that come first with their content, and those that repeat such a run elsewhere; the same run given twice is neither."""
    order = np.lexsort((runs["place"], runs["tag"], runs["doc"], runs["content"], runs["anchor"]))
    anchor, content, doc, tag, place = (runs[n][order] for n in ("anchor", "content", "doc", "tag", "place"))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, np.int64)
    return order[new], order[(doc != doc[lead]) | (tag != tag[lead]) | (place != place[lead])]


#: Bits that tell which documents have rows to meet: one megabyte, sent to every executor.
DOC_BITS = 23


def _bit(doc: np.ndarray) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(np.uint64) + np.uint64(77)) >> np.uint64(64 - DOC_BITS)).astype(np.int64)


def _doc_part(doc: np.ndarray, tag: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[(mix64(doc.astype(np.int64).view(np.uint64) + mix64(tag.astype(np.int64).view(np.uint64))) % np.uint64(len(keys))).astype(np.int64)]


def _tag(data: bytes | memoryview) -> int:
    return xxhash.xxh3_64_intdigest(data) >> 1


def _anchor_part(anchor: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[(anchor % np.uint64(len(keys))).astype(np.int64)]


def _out(kind: str, pairs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    found = list(pairs)
    for at in range(0, len(found), 2048):
        block = found[at : at + 2048]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in block], pa.int32()), pa.array([kind] * len(block)), pa.array([b for _, b in block], pa.binary())], names=["part", "kind", "data"])


def _cuts(runs: dict[str, np.ndarray], rows: np.ndarray, length: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Removals of whole runs, for the parts of their documents."""
    if len(rows):
        place = runs["place"][rows].astype(np.int64)
        values = {"doc": runs["doc"][rows], "tag": runs["tag"][rows], "begin": place - runs["before"][rows], "end": place - runs["after"][rows] + length}
        yield from _out("cut", _columns(values, _CUT, _doc_part(values["doc"], values["tag"], keys)))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches covered by the stretches given; stretches that touch are one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1) if len(begin) else np.empty(0, np.int64)
    return begin[new], end[last]


#: Bytes of text whose runs a task holds, as long as that asks for no more than MORE_PARTS times the session's shuffle partitions.
PART_BYTES, MORE_PARTS = 8 << 20, 8


def _parts(rows: DataFrame) -> int:
    """As many parts as the session shuffles to, and more where the texts ask for it."""
    own = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(own, min(MORE_PARTS * own, -(-size // PART_BYTES)))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = 36, anchor_runs: int = ANCHOR_RUNS, whole_characters: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(key, n_bytes, spans, kept) of every row and its columns in ``carry``: the stretches removed, and the bytes left.

    A byte goes if a window of ``length`` bytes (at most 255 more than ``gram``) that covers it also
    starts earlier. Null and empty texts have no bytes; texts shorter than ``length`` stay whole.
    The key is a long; rows that repeat a key and its text are one document
    and get the same result. Rows that repeat a key with other texts are documents of their own, in an order that the
    digests of their texts decide. Rows with a null key stay whole and remove nothing. Other columns
    aren't read. No window is skipped, whatever its anchor's number of runs. With ``whole_characters``
    a removed stretch shrinks to the characters that lie in it as a whole, so that what is left is text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    parts = _parts(rows)
    keys = even_keys(spark, parts)
    more = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    carried = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), F.struct(*(more or [F.lit(0).alias("none")])).alias("carried"))
    schema = "part int, kind string, data binary"

    def runs_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = np.unpackbits(repeats_bits.value).view(bool)
        for whole in stream:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                found: dict[str, list[np.ndarray]] = {n: [] for n, _ in _RUN}
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                    data = np.frombuffer(value.as_buffer() or b"", np.uint8) if value.is_valid else ()
                    if doc is None or len(data) < length:
                        continue
                    runs = Runs(data, length, gram)
                    tag = _tag(value.as_buffer()) if repeated[_bit(np.int64(doc))] else 0
                    for n, v in (("anchor", runs.anchor), ("content", runs.content), ("doc", np.full(len(runs.place), doc)), ("tag", np.full(len(runs.place), tag)), ("place", runs.place), ("before", runs.place - runs.first), ("after", runs.place - runs.last)):
                        found[n].append(v)
                if not found["doc"]:
                    continue
                values = {n: np.concatenate(v) for n, v in found.items()}
                left, repeats = _earlier(values)
                yield from _cuts(values, repeats, length, keys)
                values = {n: v[left] for n, v in values.items()}
                yield from _out("run", _columns(values, _RUN, _anchor_part(values["anchor"], keys)))

    def blobs_of(stream: Iterator[pa.RecordBatch], own: str) -> Iterator[bytes | pa.RecordBatch]:
        """The data of one kind of row; batches of the other rows pass."""
        for batch in stream:
            mine = pa.compute.equal(batch.column(1), own)
            yield from batch.filter(mine).column(2).to_pylist()
            if (rest := batch.filter(pa.compute.invert(mine))).num_rows:
                yield rest

    def first_runs(stream: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
        blobs = []
        for x in blobs_of(stream, "run"):
            if isinstance(x, bytes):
                blobs.append(x)
            else:
                yield x
        runs = _unpacked(blobs, _RUN)
        left, repeats = _earlier(runs)
        yield from _cuts(runs, repeats, length, keys)
        anchor = runs["anchor"][left]
        if exact or not len(left):  # single windows: equal content is all there is to know
            return
        _, group, counts = np.unique(anchor, return_inverse=True, return_counts=True)
        several = counts[group] > 1
        values = {n: runs[n][left][several] for n in ("anchor", "doc", "tag", "place", "before", "after")} | {"hot": counts[group][several] > anchor_runs}
        if several.any():
            yield from _out("ask", _columns(values, _ASK, _doc_part(values["doc"], values["tag"], keys)))

    def fetch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of runs asked for; windows of anchors with very many runs go one by one."""
        asked: dict[str, np.ndarray] | None = None
        blobs: list[bytes] = []
        for batch in stream:
            kinds = batch.column(0).to_pylist()
            texts = batch.column(3).cast(pa.binary())
            packed: dict[int, list] = {}
            windows: dict[str, list[np.ndarray]] = {n: [] for n, _ in _RUN}
            for i, kind in enumerate(kinds):
                if kind == 0:
                    blobs.append(batch.column(2)[i].as_py())
                    continue
                if asked is None:
                    asked = _unpacked(blobs, _ASK)
                    order = np.argsort(asked["doc"], kind="stable")
                    asked = {n: v[order] for n, v in asked.items()}
                doc = batch.column(1)[i].as_py()
                if doc is None:
                    continue
                low, high = np.searchsorted(asked["doc"], doc, "left"), np.searchsorted(asked["doc"], doc, "right")
                if low == high:
                    continue
                data = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                tag = batch.column(4)[i].as_py()
                for k in range(low, high):
                    if asked["tag"][k] != tag:
                        continue
                    place = int(asked["place"][k])
                    first, last = place - int(asked["before"][k]), place - int(asked["after"][k])
                    if asked["hot"][k]:
                        names = rolling(np.frombuffer(data, np.uint8)[first : last + length], length)
                        n = len(names)
                        for name, v in (("anchor", names), ("content", mix64(names)), ("doc", np.full(n, doc)), ("tag", np.full(n, tag)), ("place", np.arange(first, last + 1)), ("before", np.zeros(n)), ("after", np.zeros(n))):
                            windows[name].append(v)
                    else:
                        anchor = int(asked["anchor"][k])
                        packed.setdefault(int(keys[anchor % parts]), []).append((doc, place, first, last, data[first : last + length], tag))
            yield from _out("context", ((p, pickle.dumps(c, 5)) for p, c in packed.items()))
            if windows["doc"]:
                values = {n: np.concatenate(v) for n, v in windows.items()}
                left, repeats = _earlier(values)
                yield from _cuts(values, repeats, length, keys)
                values = {n: v[left] for n, v in values.items()}
                yield from _out("run", _columns(values, _RUN, _anchor_part(values["anchor"], keys)))

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[Row] = []
        for x in blobs_of(stream, "context"):
            if isinstance(x, bytes):
                members += [(doc, place, first, last, first, data, tag) for doc, place, first, last, data, tag in pickle.loads(x)]
            else:
                yield x
        cuts = windows_seen_before(members, length, gram)
        if cuts:
            values = dict(zip(("doc", "tag", "begin", "end"), np.array(cuts, np.int64).T, strict=True))
            yield from _out("cut", _columns(values, _CUT, _doc_part(values["doc"], values["tag"], keys)))

    def finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts: dict[str, np.ndarray] | None = None
        blobs: list[bytes] = []
        for batch in stream:
            texts = batch.column(3).cast(pa.binary())
            out: list[tuple] = []
            at: list[int] = []
            for i, kind in enumerate(batch.column(0).to_pylist()):
                if kind == 0:
                    blobs.append(batch.column(2)[i].as_py())
                    continue
                if cuts is None:
                    cuts = _unpacked(blobs, _CUT)
                    order = np.argsort(cuts["doc"], kind="stable")
                    cuts = {n: v[order].astype(np.int64) for n, v in cuts.items()}
                doc, value = batch.column(1)[i].as_py(), texts[i]
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                low, high = (np.searchsorted(cuts["doc"], doc, side) for side in ("left", "right")) if doc is not None else (0, 0)
                own = cuts["tag"][low:high] == batch.column(4)[i].as_py()
                begin, end = merged(cuts["begin"][low:high][own], cuts["end"][low:high][own])
                if whole_characters and len(begin):
                    starts = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
                    begin, end = starts[np.searchsorted(starts, begin, "left")], starts[np.searchsorted(starts, end, "right") - 1]
                spans = list(zip(begin.tolist(), end.tolist(), strict=True))
                places = [0, *(x for s in spans for x in s), len(data)]
                at.append(i)
                out.append((doc, len(data), [{"begin": b, "end": e} for b, e in spans], b"".join([data[a:b] for a, b in zip(places[::2], places[1::2], strict=True)])))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)), batch.column(5).take(pa.array(at))], names=["doc", "n_bytes", "spans", "kept", "carried"])

    def bits_of(documents):
        """The documents of batches, as set bits; pieces that are all zero aren't sent."""

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << DOC_BITS, bool)
            for batch in stream:
                bits[_bit(documents(batch.column(0)))] = True
            yield from pieces(np.packbits(bits))

        return run

    def pieces(bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = [k for k in range(0, len(bits), 4096) if bits[k : k + 4096].any()]
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([bits[k : k + 4096].tobytes() for k in used], pa.binary())], names=["at", "bits"])

    def joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << DOC_BITS) // 8, np.uint8)
        for batch in stream:
            for at, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits[at : at + 4096] |= np.frombuffer(piece, np.uint8)
        yield from pieces(bits)

    def concerned(found: DataFrame, documents):
        """A broadcast of 2**DOC_BITS bits, whatever the corpus; a bit set by another document only costs a look."""
        found = found.mapInArrow(lean(bits_of(documents)), "at int, bits binary").repartition(8, "at").mapInArrow(lean(joined), "at int, bits binary")
        bits = np.zeros((1 << DOC_BITS) // 8, np.uint8)
        for at, piece in found.collect():
            bits[at : at + 4096] = np.frombuffer(piece, np.uint8)
        return spark.sparkContext.broadcast(bits)

    def in_blobs(kind: list):
        return lambda column: _unpacked(column.to_pylist(), kind)["doc"]

    def placed(bits, wanted: bool, of: DataFrame):
        """Rows whose document has its bit set, or those that haven't, with their part."""

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known_bits, repeated = np.unpackbits(bits.value).view(bool), np.unpackbits(repeats_bits.value).view(bool)
            for batch in stream:
                doc = batch.column(0)
                number = pa.compute.fill_null(doc, 0).to_numpy()
                named = doc.is_valid().to_numpy(zero_copy_only=False) & known_bits[_bit(number)]
                batch = batch.filter(pa.array(named == wanted))
                n = batch.num_rows
                if n:
                    number = number[named == wanted]
                    tag, texts = np.zeros(n, np.int64), batch.column(1).cast(pa.binary())
                    for i in np.flatnonzero(repeated[_bit(number)]).tolist():
                        tag[i] = _tag(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                    part = _doc_part(number, tag, keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), batch.column(0), pa.nulls(n, pa.binary()), batch.column(1), pa.array(tag), *batch.columns[2:], pa.array(part)], names=names)

        struct = [f"carried {of.schema['carried'].dataType.simpleString()}"] if "carried" in of.columns else []
        names = ["kind", "doc", "data", "text", "tag", *of.columns[2:], "part"]
        return of.mapInArrow(lean(run), ", ".join(["kind int, doc long, data binary, text string, tag long", *struct, "part int"]))

    def of_documents(blobs: DataFrame, bits, work, out: str, of: DataFrame) -> DataFrame:
        """The documents concerned meet the rows for their part, which come first."""
        second = placed(bits, True, of)
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in second.schema.fields}
        first = blobs.select(*[c.alias(n) for n, c in (nothing | {"kind": F.lit(0), "data": F.col("data"), "part": F.col("part")}).items()])
        met = first.union(second).repartition(parts, "part").sortWithinPartitions("kind")
        return met.drop("part").mapInArrow(lean(work), out)

    def dealt(blobs: DataFrame, work) -> DataFrame:
        return blobs.repartition(parts, "part").mapInArrow(lean(work), schema)

    repeats_bits = concerned(rows.groupBy("doc").count().filter("count > 1 and doc is not null").select("doc"), lambda column: column.to_numpy())
    firsts = materialize(dealt(rows.mapInArrow(lean(runs_of), schema), lambda s: first_runs(s, False)))
    ask = firsts.filter("kind = 'ask'")
    fetched = of_documents(ask, concerned(ask.select("data"), in_blobs(_ASK)), fetch, schema, rows)
    compared = materialize(dealt(dealt(fetched, lambda s: first_runs(s, True)), compare))
    cut = firsts.filter("kind = 'cut'").union(compared.filter("kind = 'cut'"))
    bits = concerned(cut.select("data"), in_blobs(_CUT))
    result = f"doc long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary, carried {carried.schema['carried'].dataType.simpleString()}"
    whole = placed(bits, False, carried).select(
        "doc", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.from_json(F.lit("[]"), "array<struct<begin:long,end:long>>").alias("spans"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("kept"), "carried"
    )
    found = of_documents(cut, bits, finish, result, carried).union(whole)
    return found.select(F.col("doc").alias(key), "n_bytes", "spans", "kept", *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(carry)])
