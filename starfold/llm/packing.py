"""Best-fit packing: documents as token pieces, packed into sequences by bin completion with branch and bound."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.common import lean, others, small, spare_name, worker_memory


#: Bytes of text whose words are looked up together.
AT_ONCE = 4_000_000
#: Whether all letters are of Latin-1.
LATIN = re.compile("[\x00-\xff]*").fullmatch


def _stops_apart(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words, a last ``.`` or ``,`` after a letter of Latin-1 as a word of its own; and which words had one."""
    wide = pa.types.is_large_string(words.type)
    at = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1]
    if not len(words) or at[0] == at[-1]:
        return words, np.zeros(len(words), bool)
    byte = np.frombuffer(words.buffers()[2], np.uint8)
    last = byte[np.maximum(at[1:] - 1, 0)]
    ends = np.flatnonzero(((last == 0x2E) | (last == 0x2C)) & (np.diff(at) > 1))
    before, ahead = byte[at[ends + 1] - 2], byte[np.maximum(at[ends + 1] - 3, 0)]
    letter = ((before | 0x20) >= 0x61) & ((before | 0x20) <= 0x7A) & (before < 0x80)
    letter |= (ahead == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)  # but for the signs of times and division
    ends = ends[letter]
    had = np.zeros(len(words), bool)
    had[ends] = True
    return type(words).from_buffers(len(words) + len(ends), pa.py_buffer(np.insert(at, ends + 1, at[ends + 1] - 1)), words.buffers()[2]), had


def _within(words: pa.Array, those: pa.Array) -> np.ndarray:
    """The place of each word in ``those``, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=those), -1).to_numpy().astype(np.int64)


def _gather(ids: np.ndarray, stops: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``at``, one entry after the other, and where each begins, with the end. Entry i has ids[stops[i] : stops[i + 1]]."""
    out = np.zeros(len(at) + 1, np.int64)
    np.cumsum(stops[at + 1] - stops[at], out=out[1:])
    source = np.repeat(stops[at] - out[:-1], np.diff(out))
    source += np.arange(len(source))
    return ids[source], out


class _Words:
    """Distinct words and their ids as Arrow and numpy columns, some 40 bytes a word; a dict takes over 100."""

    def __init__(self):
        self.words, self.ids, self.stops = pa.array([""]), np.empty(0, "<u4"), np.zeros(2, np.int64)

    def __iter__(self) -> Iterator[str]:
        return iter(self.words.to_pylist())

    @property
    def used(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.stops.nbytes

    def find(self, words: pa.Array) -> np.ndarray:
        return _within(words, self.words)

    def add(self, words: pa.Array, ids: np.ndarray, stops: np.ndarray) -> int:
        """Append words that aren't here yet; the place of the first."""
        first = len(self.words)
        self.words = pa.concat_arrays([self.words, words])
        self.stops = np.concatenate([self.stops, stops[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        return first


class WordTokenizer:
    """Packed ids of a ``tokenizers`` file whose pre-tokens never hold white space and end in tokens of their own.

    Such a text's ids are those of its words, and a word's those of its pre-tokens. Arrow cuts many texts into words
    and numbers the distinct ones; only these are looked up, and their ids then go to every place of theirs at once. The
    distinct pre-tokens that aren't remembered go to the library together, and the tokens that end pre-tokens tell whose ids are
    whose. Words and pre-tokens are remembered in columns, which Arrow searches, of two generations of ``limit`` bytes, so that
    what is asked for again outlives the rest.
    With ``added``, the file's added tokens get their own ids, as by the library's default, and texts that hold
    one go whole to the library; else they are spelled as ordinary text.
    """

    _separators = r"[\x{1c}-\x{1f}]"  # white space to Arrow, not to the tokenizer
    _others = r"[^\x{0}-\x{ff}]"

    def __init__(self, spec: str, pattern: str, limit: int = 16_000_000, added: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        described = json.loads(spec)
        self.added = [t["content"] for t in described.get("added_tokens") or []] if added else []
        if not added:
            self.tokenizer.encode_special_tokens = True
        self.joint = Tokenizer(self.tokenizer.model)  # the same model, for pre-tokens that are normalized and cut already
        self.joint.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(described["model"]["end_of_word_suffix"])]] = True
        self.split = regex.compile(pattern).findall
        self.limit, self.known, self.old = limit, _Words(), _Words()

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, word: str) -> list[str]:
        """Pre-tokens of a lower-cased Latin-1 word, which needs no other normalizing."""
        if word.isalpha():
            return [word]
        return [word[:-1], word[-1]] if word[-1] in ".," and word[:-1].isalpha() else self.split(word)

    def _resolve(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, encoded as one text; each has one token that ends it."""
        ids = np.array(self.joint.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.int64)
        stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        packed = ids.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _recall(self, words: pa.Array) -> np.ndarray:
        """Places of the words in the new generation, after what only the old one has is brought back; -1 for those that neither has."""
        at = self.known.find(words)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rest = words.take(pa.array(missing))
            some = rest.unique()
            there = self.old.find(some)
            if (there >= 0).any():
                some = some.filter(pa.array(there >= 0))
                first = self.known.add(some, *_gather(self.old.ids, self.old.stops, there[there >= 0]))
                back = _within(rest, some)
                at[missing] = np.where(back < 0, -1, first + back)
        return at

    def _learn(self, words: pa.Array) -> int:
        """Remember words that neither generation has, and their pre-tokens; the place of the first word."""
        new, whole, cut, found = words.to_pylist(), [], {}, {}
        for word in new:
            if not (word.isascii() or LATIN(word)):
                found[word] = self._library(word)
            elif len(pieces := self._pieces(word)) == 1:
                whole.append(word)
            else:
                cut[word] = pieces
        pieces = list(set().union(*cut.values()).difference(whole))
        at = self._recall(pa.array(pieces, pa.string()))
        alone = [p for p, k in zip(pieces, at.tolist(), strict=True) if k < 0]
        resolve = whole + alone
        for k in range(0, len(resolve), 1000):
            some = resolve[k : k + 1000]
            found.update(zip(some, self._resolve(some), strict=True))
        ids, stops = self.known.ids, self.known.stops
        known = {p: ids[stops[k] : stops[k + 1]].tobytes() for p, k in zip(pieces, at.tolist(), strict=True) if k >= 0}
        found |= {word: b"".join([known[p] if p in known else found[p] for p in parts]) for word, parts in cut.items()}
        new += [p for p in alone if p not in cut]
        packed = [found[w] for w in new]
        stops = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
        return self.known.add(pa.array(new, pa.string()), np.frombuffer(b"".join(packed), "<u4"), stops)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one word after the other, and where each begins, with the end."""
        at = self._recall(words)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rest = words.take(pa.array(missing))
            new = rest.unique()
            at[missing] = self._learn(new) + _within(rest, new)
        found = _gather(self.known.ids, self.known.stops, at)
        if self.known.used > self.limit:
            self.old, self.known = self.known, _Words()
        return found

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of each text."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        at, done = 0, 0
        while at < len(texts):
            end = min(len(texts), int(np.searchsorted(ends, done + AT_ONCE)) + 1)
            yield from self._encode_some(texts.slice(at, end - at))
            at, done = end, int(ends[end - 1])

    def _encode_some(self, texts: pa.Array) -> Iterator[bytes]:
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self._separators)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        parted = pc.if_else(whole, pa.scalar("", texts.type), texts)
        other = pc.match_substring_regex(parted, self._others)
        mixed = pc.any(other).as_py()
        lower = pc.utf8_lower(parted)
        if mixed:  # the library normalizes words with other letters
            lower = pc.if_else(other, parted, lower)
        cut = pc.utf8_split_whitespace(lower)
        texts_end = np.cumsum(pc.list_value_length(cut).to_numpy())
        words, added = _stops_apart(cut.flatten())
        texts_end += np.concatenate(([0], np.cumsum(added)))[texts_end]
        numbered = words.dictionary_encode()
        distinct = numbered.dictionary.cast(pa.string())
        if mixed:
            distinct = pa.array([w.lower() if w.isascii() or LATIN(w) else w for w in distinct.to_pylist()], pa.string())
        places = numbered.indices.to_numpy()
        ids, stops = _gather(*self._ids(distinct), places)
        stops = stops[np.concatenate(([0], texts_end))]
        for i, alone in enumerate(whole.to_numpy(zero_copy_only=False).tolist()):
            yield self._library(texts[i].as_py()) if alone else ids[stops[i] : stops[i + 1]].tobytes()


#: Fixed value: the pre-token pattern of the word-end tokenizer's file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Rows of a group that is packed by itself, on average.
GROUP_ROWS = 4096


def pieces(docs: DataFrame, spec: str, text: str = "text", end_id: int = 1, capacity: int = 4096, pattern: str = WORD_PATTERN, with_ids: bool = True, added: bool = False) -> DataFrame:
    """One row for each piece of at most ``capacity`` tokens of each row's ids, ``end_id`` appended.

    ``spec`` is the tokenizer file's content; with ``added``, its added tokens get their own ids. The row's columns but the text stay; added are
    ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` and, on request, ``ids`` (packed).
    A null or empty text is the one piece [end_id]. Only texts longer than ``capacity`` are cut.
    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    made = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType()} | ({"ids": T.BinaryType()} if with_ids else {})
    keep = others(docs, text, *made)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in made.items()])
    tail = np.array([end_id], "<u4").tobytes()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_memory(("words", zlib.crc32(shared.value.encode()), pattern, added), lambda: WordTokenizer(shared.value, pattern, added=added))
        for batch in small(stream, 4096):
            rows, out = [], {n: [] for n in made}
            for i, body in enumerate(tokenizer.encode_all(batch.column(batch.schema.get_field_index(text)))):
                ids = body + tail
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append(i)
                    for n, v in zip(made, (k, start // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        out[n].append(v)
            kept = batch.select(keep).take(pa.array(rows, pa.int64())) if keep else None
            made_columns = [pa.array(out[n], {"piece": pa.int32(), "ids": pa.binary()}.get(n, pa.int64())) for n in made]
            yield pa.RecordBatch.from_arrays([*(kept.columns if kept else []), *made_columns], names=[*keep, *made])

    return docs.mapInArrow(lean(run, keeps=True), schema)


class _Stock:
    """Items by length. ``lengths`` has bit l set while an item of length l is left."""

    def __init__(self, lengths: list[int], capacity: int):
        self.counts = [0] * (capacity + 1)
        for n in lengths:
            self.counts[n] += 1
        self.lengths = sum(1 << n for n in set(lengths))

    def largest(self, most: int) -> int:
        """The largest length left that is at most ``most``; -1 if there is none."""
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1 if most >= 0 else -1

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.lengths ^= 1 << n

    def give(self, n: int) -> None:
        if not self.counts[n]:
            self.lengths |= 1 << n
        self.counts[n] += 1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, largest first, goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for n in sorted(lengths, reverse=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(n)
        room -= n
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def _covers(better: tuple[int, ...], worse: tuple[int, ...]) -> bool:
    """Whether ``worse`` fits into the items of ``better``, each taken as a bin: then ``better`` dominates it."""
    rooms = list(better)
    for n in worse:
        for i, room in enumerate(rooms):
            if n <= room:
                rooms[i] = room - n
                break
        else:
            return False
    return True


#: Fillings that are looked at together, so that the fuller ones come first.
BURST = 32


class _Search:
    """Steps left, and whether everything that the bounds left open has been looked at."""

    def __init__(self, steps: int):
        self.steps, self.complete = steps, True

    def spend(self) -> bool:
        self.steps -= 1
        self.complete &= self.steps >= 0
        return self.steps >= 0


def _fillings(stock: _Stock, room: int, slack: int, search: _Search) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, items) of all maximal fillings of ``room`` with at most ``slack`` of waste, none dominated by one before it.

    Depth first, the largest items first; each burst of fillings is handed out by its waste.
    Between fillings the stock is as it was.
    """
    kept: list[tuple[int, ...]] = []
    burst: list[tuple[int, tuple[int, ...]]] = []
    chosen: list[int] = []
    left = most = room
    going = True
    while going and search.spend():
        n = stock.largest(min(left, most))
        if n >= 0:
            stock.take(n)
            chosen.append(n)
            left, most = left - n, n
            continue
        if left <= slack and stock.largest(left) < 0:  # else an item could be added
            burst.append((left, tuple(chosen)))
        if chosen:
            n = chosen.pop()
            stock.give(n)
            left, most = left + n, n - 1
        else:
            going = False
        if burst and (not going or len(burst) == BURST or burst[-1][0] == 0):
            for n in chosen:
                stock.give(n)
            for waste, items in sorted(burst, key=lambda f: (f[0], len(f[1]))):
                if not any(_covers(k, items) for k in kept):
                    kept.append(items)
                    yield waste, items
            burst.clear()
            for n in chosen:
                stock.take(n)
    for n in chosen:
        stock.give(n)
    yield from sorted(burst)


def bin_completion(lengths: list[int], capacity: int) -> list[list[int]]:
    """As few bins of at most ``capacity`` as the search finds."""
    return proven_bins(lengths, capacity)[0]


def proven_bins(lengths: list[int], capacity: int, steps: int = 20_000) -> tuple[list[list[int]], bool]:
    """As few bins as the search finds, and whether no solution can have less. Best fit is the incumbent from the start.

    Bins are completed around the largest item left, with every undominated filling whose waste a
    solution of one bin less than the incumbent's could still have. The search ends at the volume bound,
    where no solution can be better, when nothing is left open, or after ``steps`` items tried beyond
    one descent; then the incumbent is returned as not proven.
    """
    best = best_fit(lengths, capacity)
    total = sum(lengths)
    bound = max(-(-total // capacity), sum(1 for n in lengths if 2 * n > capacity))
    if len(best) <= bound:
        return best, True
    stock = _Stock(lengths, capacity)
    search = _Search(steps + 2 * len(lengths))
    done: list[list[int]] = []
    wasted = 0
    allowed = (len(best) - 1) * capacity - total
    trail: list[tuple[int, Iterator[tuple[int, tuple[int, ...]]]]] = []

    def open_bin() -> None:
        first = stock.largest(capacity)
        stock.take(first)
        trail.append((first, _fillings(stock, capacity - first, allowed - wasted, search)))

    open_bin()
    while trail:
        first, fillings = trail[-1]
        if len(done) == len(trail):  # back from below: undo this bin's filling
            items = done.pop()
            for n in items[1:]:
                stock.give(n)
            wasted -= capacity - sum(items)
        filling = next(fillings, None)
        if filling is None:
            stock.give(first)
            trail.pop()
            continue
        waste, items = filling
        if wasted + waste > allowed:
            continue
        for n in items:
            stock.take(n)
        done.append([first, *items])
        wasted += waste
        if stock.lengths:
            open_bin()
            continue
        best = [list(b) for b in done]
        allowed = (len(best) - 1) * capacity - total
        if len(best) <= bound:
            return best, True
    return best, search.complete


def _place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int], bool]:
    """Bin and offset of each item, the fill of each bin, and whether no packing has fewer bins."""
    queues: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        queues.setdefault(int(lengths[i]), []).append(i)
    bins, proven = proven_bins(lengths.tolist(), capacity)
    at, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for b, items in enumerate(bins):
        used = 0
        for n in items:
            i = queues[n].pop()
            at[i], offset[i] = b, used
            used += n
        fill.append(used)
    return at, offset, fill, proven


def pack(rows: DataFrame, groups: int, length: str = "length", capacity: int = 4096, merge: int = 16, spread: tuple[str, ...] = ()) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: sequences of at most ``capacity``, gapless from 0; and ``proven``.

    Rows are dealt by their place and the hash of the columns in ``spread`` (all columns if none is named) to
    ``groups`` groups, each packed by itself, so that repeated rows don't meet in one. Then the sequences left
    open by ``merge`` groups at a time are packed anew, so that about one sequence in ``merge`` groups stays part
    empty. Lengths run from 1 to ``capacity``; rows with other or null lengths get null. ``proven`` tells
    whether the group that packed the row last can't do with fewer sequences; elsewhere the search ran out of steps.
    Columns of these three names are replaced. Rows must come in an order that a lost task's second run
    repeats, as files and checkpoints give it.
    """
    rows = rows.select(*others(rows, "sequence_id", "offset", "proven"))
    group, state, joint = (spare_name(rows, n) for n in ("_group", "_bin", "_merged"))
    place = F.xxhash64(*(spread or rows.columns), F.monotonically_increasing_id())
    dealt = rows.withColumns({group: F.pmod(place, F.lit(groups)).cast("long"), state: F.lit(0).cast("long"), "sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "proven": F.lit(None).cast("boolean")})
    schema = dealt.schema

    def first(part: pd.DataFrame) -> pd.DataFrame:
        fits = part[length].between(1, capacity).to_numpy()
        part[state] = -1
        if fits.any():
            at, offset, fill, proven = _place(part.loc[fits, length].to_numpy().astype(np.int64), capacity)
            still_open = np.array(fill) < capacity - capacity // 512
            part.loc[fits, state] = np.where(still_open[at], -2, 0)
            part.loc[fits, "sequence_id"] = part.loc[fits, group].to_numpy() * (1 << 32) + at
            part.loc[fits, "offset"] = offset
            part.loc[fits, "proven"] = proven
        return part

    def again(part: pd.DataFrame) -> pd.DataFrame:
        opened = (part[state] == -2).to_numpy()
        if opened.any():
            at, offset, fill, proven = _place(part.loc[opened, length].to_numpy().astype(np.int64), capacity)
            if len(fill) < part.loc[opened, "sequence_id"].nunique():
                part.loc[opened, "sequence_id"] = (part.loc[opened, group].to_numpy() // merge) * (1 << 32) + (1 << 31) + at
                part.loc[opened, "offset"] = offset
            part.loc[opened, "proven"] = proven
        return part

    order = [c for c in (*spread, length) if c in rows.columns]

    def ordered(work):
        return lambda part: work(part.sort_values(order, kind="stable").reset_index(drop=True))

    packed = dealt.groupBy(group).applyInPandas(ordered(first), schema)
    packed = packed.groupBy(F.floor(F.col(group) / merge).alias(joint)).applyInPandas(ordered(again), schema)
    return packed.drop(group, state)
