"""Collocations by SON partitioning: phrases are mined shard by shard, and only what some shard finds frequent is counted everywhere.

The corpus is dealt to a few shards. If a phrase occurs ``least`` times in all, then in one of k
shards it occurs at least ``least / k`` times; so the union of what the shards find at
that lower support misses nothing. A shard is no task: it grows with the corpus, so its phrases
are counted by many tasks and a shuffle, level by level, a phrase only where both its
shorter parts are frequent in the same shard. A shard that doesn't find a phrase holds it less often than the lower support,
which bounds the phrase's whole count: phrases that can't reach ``least`` are left out of the union and of longer phrases.
What was found is sent to the tasks as bits at hashed
places, of a size that doesn't grow with the data; two phrases at one place
cost a needless count and never a result, since the last count is by the phrase itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.llm.common import lean, mix64
from starfold.session import materialize, shared_folder

#: Shards of the corpus, at most 16; binary digits of a filter's places (16 MB); words of a chunk, more only where one document's piece has more.
SHARDS, FILTER_BITS, CHUNK_WORDS = 10, 27, 1 << 19
#: Binary digits of a phrase's hash: two bytes less of each row that is shuffled.
GRAM_BITS = 48
#: Different phrases that a task holds before it sends its counts on; how many new ones it gathers before they are merged, and in how many ranges.
HELD, GATHERED, RANGES = 3_000_000, 500_000, 16
#: A hot language's phrases are ranked in this many parts before the parts' best are ranked together.
RANK_PARTS = 32

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_PIECE_ENDS + b"\t" + bytes(range(65, 91)), b"." * len(_PIECE_ENDS) + b" " + bytes(range(97, 123)))


class _Numbers(dict):
    """word -> its number within a chunk; the end of a piece is -1."""

    def __init__(self):
        super().__init__({b".": -1})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) - 1
        return value


def _chunks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> rows of about CHUNK_WORDS words of one language: (lang, shard, n, words, ids)."""
    names = ["lang", "shard", "n", "words", "ids"]
    shard = TaskContext.get().partitionId() % SHARDS
    numbers: dict[str, _Numbers] = {}
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def close(lang: str) -> pa.RecordBatch:
        ids = np.concatenate(held.pop(lang))
        words = b" ".join(list(numbers.pop(lang))[1:])
        del sizes[lang]
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([shard], pa.int32()), pa.array([int((ids >= 0).sum())], pa.int64()), pa.array([words], pa.large_binary()).cast(pa.binary()), pa.array([ids.tobytes()], pa.binary())], names=names)

    for batch in stream:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            tokens = text.translate(_PLAIN).replace(b".", b" . ").split()
            if not tokens:
                continue
            known = numbers.setdefault(lang, _Numbers())
            ids = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
            held.setdefault(lang, []).extend([ids, np.array([-1], np.int32)])
            sizes[lang] = sizes.get(lang, 0) + len(ids)
            if sizes[lang] >= CHUNK_WORDS:
                yield close(lang)
            elif sum(sizes.values()) >= 4 * CHUNK_WORDS:  # many languages, each with little
                yield close(max(sizes, key=sizes.get))
    for lang in list(sizes):
        yield close(lang)


def _word_hashes(lang: str, words: bytes) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    parts = words.split(b" ") if words else []
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in parts), np.uint64, len(parts))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of 48 binary digits for the ``n`` words from each place on; its last 4 are left for a shard's number."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size])
    return (out >> np.uint64(64 - GRAM_BITS)) & ~np.uint64(15)


def _places(grams: np.ndarray, shard: int | None, bits: int) -> np.ndarray:
    """The place of a gram in the filter of one shard, or of all together."""
    if shard is None:
        return (grams >> np.uint64(GRAM_BITS - bits)).astype(np.int64)
    return ((grams >> np.uint64(GRAM_BITS - bits + 4)) << np.uint64(4)).astype(np.int64) | shard


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _whole(ids: np.ndarray, n: int) -> np.ndarray:
    """Places from which ``n`` words lie in one piece."""
    size = max(0, len(ids) - n + 1)
    out = np.ones(size, bool)
    for k in range(n):
        out &= ids[k : k + size] >= 0
    return out


def _counts(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in held])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in held])[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


class _Tally:
    """Counts of grams, in order. Ranges of grams are merged one by one, so that a merge copies a small part of what is held."""

    def __init__(self):
        self.ranges: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(RANGES)]
        self.merged = self.gathered = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        edges = np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << GRAM_BITS) // RANGES)
        at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for held, lo, hi in zip(self.ranges, at[:-1], at[1:], strict=True):
            if hi > lo:
                held.append((keys[lo:hi], counts[lo:hi]))
        self.gathered += len(keys)

    def merge(self) -> None:
        for held in self.ranges:
            if len(held) > 1:
                held[:] = [_counts(held)]
        self.merged, self.gathered = sum(len(k) for held in self.ranges for k, _ in held), 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All counts, which are held no longer."""
        self.merge()
        for held in self.ranges:
            for keys, counts in held:
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part])], names=["gram", "n"])
            held.clear()
        self.merged = 0


def _count_level(n: int, below, bits: int):
    """Chunks -> (gram, n): a task's counts of ``n`` words in a row, where the filters of the shard and of the union have both parts of n - 1 words."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if below is None else np.frombuffer(below.value, np.uint8).reshape(2, -1)
        tally = _Tally()
        for batch in stream:
            for lang, shard, words, ids in zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "words", "ids")), strict=True):
                if not words:
                    continue
                ids = np.frombuffer(ids, np.int32)
                hashes = _word_hashes(lang, words)[ids]
                keep = _whole(ids, n)
                if frequent is not None:
                    grams = _grams(hashes, n - 1)
                    part = _has(frequent[0], _places(grams, shard, bits)) & _has(frequent[1], _places(grams, None, bits))
                    keep &= part[: len(keep)] & part[1:]
                if keep.any():
                    tally.add(*np.unique(_grams(hashes, n)[keep] | np.uint64(shard), return_counts=True))
                if tally.gathered >= GATHERED:
                    tally.merge()
                if tally.merged >= HELD:
                    yield from tally.batches()
        yield from tally.batches()

    return lean(run)


def _count_phrases(most: int, union, bits: int):
    """Chunks -> (lang, phrase, n): a task's counts of all phrases that the union's filter has."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(union.value, np.uint8)
        for batch in stream:
            for lang, words, ids in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "ids")), strict=True):
                if not words:
                    continue
                ids = np.frombuffer(ids, np.int32)
                hashes, words = _word_hashes(lang, words)[ids], words.decode().split(" ")
                for n in range(1, most + 1):
                    grams = _grams(hashes, n)
                    at = np.flatnonzero(_whole(ids, n) & _has(frequent, _places(grams, None, bits)))
                    order = np.lexsort([ids[at + k] for k in range(n)])  # by the words themselves, not by hashes
                    at = at[order]
                    new = np.zeros(len(at), bool)
                    new[:1] = True
                    for k in range(n):
                        new[1:] |= ids[at[1:] + k] != ids[at[:-1] + k]
                    starts = np.flatnonzero(new)
                    counts = np.diff(np.append(starts, len(at)))
                    columns = [ids[at[starts] + k].tolist() for k in range(n)]
                    for lo in range(0, len(starts), 1 << 16):
                        phrases = [" ".join(map(words.__getitem__, p)) for p in zip(*(c[lo : lo + (1 << 16)] for c in columns), strict=True)]
                        part = counts[lo : lo + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.string()), pa.array(part.astype(np.int64))], names=["lang", "phrase", "n"])

    return lean(run)


def _filters(frequent: DataFrame, possible: DataFrame, bits: int) -> np.ndarray:
    """Bits of the grams frequent in a shard, and of those possible in all, as two rows; at most 2 ** (bits - 5) longs come to the driver, whatever the data."""
    gram = F.col("gram")
    head = F.shiftleft(F.shiftright(gram, GRAM_BITS - bits + 4), 4)
    local = frequent.select(F.lit(0).alias("kind"), head.bitwiseOR(gram.bitwiseAND(F.lit(15))).alias("place"))
    every = possible.select(F.lit(1).alias("kind"), F.shiftright(gram, GRAM_BITS - bits).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    found = local.union(every).groupBy("kind", F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    kind, word, value = (found[c].to_numpy() for c in ("kind", "word", "bits"))
    out = np.zeros((2, 1 << (bits - 6)), np.int64)
    out[kind, word] = value
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, least: int, longest: int = 4, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of 1 to ``longest`` words that occur ``least`` times in a language, (lang, n) all words).

    Words are runs of bytes other than space and tab within pieces, which end at ``.,;:!?`` and
    line ends; A-Z is lower-cased; phrases don't cross pieces, and their occurrences may overlap. Null texts
    are empty, a null language is ``und``; a language without words gives no row. Other columns aren't read. Counts are exact.
    """
    spark, bits = docs.sparkSession, FILTER_BITS
    folder = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows.mapInArrow(lean(_chunks), "lang string, shard int, n long, words binary, ids binary").write.options(**{"compression": "zstd", "parquet.block.size": 32 << 20}).parquet(folder)
    chunks = spark.read.parquet(folder)
    local = -(-least // SHARDS)
    union, below = np.zeros(1 << (bits - 3), np.uint8), None
    for n in range(1, longest + 1):
        # tasks have counted already: dealt by gram before they are summed, rows aren't held in a second table of each task
        counted = chunks.select("lang", "shard", "words", "ids").mapInArrow(_count_level(n, below, bits), "gram long, n long").repartition("gram")
        frequent = materialize(counted.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= local))
        elsewhere = (F.lit(SHARDS) - F.count("n")) * (local - 1)  # at most, in shards where it isn't frequent
        possible = frequent.groupBy(F.col("gram").bitwiseAND(F.lit(~15)).alias("gram")).agg((F.sum("n") + elsewhere).alias("most")).filter(F.col("most") >= least)
        found = _filters(frequent, possible, bits)
        union |= found[1]
        if below is not None:
            below.destroy()
        below = spark.sparkContext.broadcast(found.tobytes())
    every = spark.sparkContext.broadcast(union.tobytes())
    phrases = chunks.select("lang", "words", "ids").mapInArrow(_count_phrases(longest, every, bits), "lang string, phrase string, n long")
    found = phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return materialize(found), materialize(chunks.groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words that occur ``least`` times.

    A phrase cut after its first k words into parts that occur l and r times scores
    floor(2000000 * a / (l + r)); its lowest-scoring cut counts, the smallest k of equal ones. Phrases
    whose words lie within a longer one that occurs at least ``covered`` percent as often are left out. Order:
    score and a descending, phrase ascending by bytes. Texts and words as in ``frequent_phrases``; no texts give no rows.
    """
    counts, words = frequent_phrases(docs, least, longest, lang, text)
    split = F.split("phrase", " ")
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), split.alias("w")).filter(F.size("w") >= 2)
    join = lambda part: F.array_join(part, " ")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.expr("slice(w, 1, k)")).alias("first"), join(F.expr("slice(w, k + 1, size(w) - k)")).alias("rest"))
    # both parts of a frequent phrase are frequent themselves, so that these joins find all
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    within = candidates.filter(F.size("w") >= 3).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("f"))
    longer = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or cast(100 as decimal(20, 0)) * longer < cast({covered} as decimal(20, 0)) * a"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
