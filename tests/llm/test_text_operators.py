"""Per-document operators: round trips, brute force, edge cases, held-out accuracy."""

import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from starfold.llm import bpe, langid, packing, quality, token_counts, toxicity

TEXTS = [None, "", " ", "a  b\n\n c ", "it's we'll 'tis", "日本語 テスト 123 ½²³", "é" * 300, "x" * 20000, "a\x1c b \x1d c", "<|endoftext|> text", "tabs\t\tand  spaces   ", "repeated repeated repeated"]
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "kept", i * 2) for i, t in enumerate(TEXTS)] + [(None, "no key", None, None), (1, "", "kept", 2)], "doc_id long, text string, IDS string, piece long")


def test_perfect_hash_is_minimal_and_exact(vocabulary):
    table = vocabulary.table
    assert sorted(table.values) == sorted(r for _, r in RANKS)
    assert all(table.get(k) == r for k, r in RANKS[:2000])
    assert table.get(b"surely not one token") == -1
    assert bpe.MinimalPerfectHash([]).buckets == 1


def test_bpe_equals_the_library_and_round_trips(spark, vocabulary, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})
    out = bpe.decode(bpe.encode(texts, vocabulary, ids="packed"), vocabulary, ids="packed").collect()
    assert len(out) == len(TEXTS) + 2
    for row in out:
        text = row["text"] or ""
        assert np.frombuffer(row["packed"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
        assert row["IDS"] in ("kept", None)
    assert bpe.encode(texts.limit(0), vocabulary, ids="packed").count() == 0
    assert bpe.encode(texts, vocabulary).columns == ["doc_id", "text", "piece", "ids"]  # IDS is replaced


def test_token_counts_add_up_under_every_rule(spark, texts):
    ranks = dict(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sum(len(library.encode_ordinary(t or "")) for t in [*TEXTS, "no key", ""])
    thirds = lambda t: [(a, b) for a, b in pairwise(np.linspace(0, len(t), 4).astype(int).tolist())]
    for rule in token_counts.RULES:
        for sections in (token_counts.lines, thirds):
            found = token_counts.count_tokens(texts, ranks, public_tokenizers.PATTERN, sections=sections, rule=rule)
            assert found.agg(F.sum("n_tokens")).first()[0] == pytest.approx(expected)
    with pytest.raises(ValueError):
        token_counts.attribute(np.array([0]), np.array([1]), [(0, 1)], "guess")


def test_crossing_tokens_follow_the_rule():
    starts, ends = np.array([0, 2, 6]), np.array([2, 6, 8])
    sections = [(0, 3), (3, 8)]
    count = lambda rule: token_counts.attribute(starts, ends, sections, rule)[0].tolist()
    assert count("start") == [2, 1] and count("end") == [1, 2] and count("most") == [1, 2] and count("share") == [1.25, 1.75]


def test_pieces_equal_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        out = packing.pieces(texts.withColumn("row", F.monotonically_increasing_id()), f.read(), capacity=50).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["row"], r["piece"])):
        ids = bytes(r["ids"])
        assert len(ids) == 4 * r["length"] <= 200 and zlib.crc32(ids) == r["ids_crc32"]
        assert r["start"] == len(got.get(r["row"], b"")) // 4
        got[r["row"]] = got.get(r["row"], b"") + ids
    expected = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in [*TEXTS, "no key", ""])
    assert sorted(got.values()) == expected


def test_words_are_looked_up_once_without_their_stops():
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    words = packing.WordTokenizer(spec, packing.WORD_PATTERN)
    empty = pa.array([None, "", " "], pa.string())
    assert list(words.encode_all(empty)) == [b""] * 3 and list(words.encode_all(empty[:0])) == []
    list(words.encode_all(pa.array(["Stem stem. STEM,", "stem, stem"])))
    assert set(words.known) == {"", "stem", ".", ","}  # not "stem." and "stem," besides
    library = Tokenizer.from_str(spec)
    library.encode_special_tokens = True
    parts = ["a", "B", "é", "É", "×", "÷", ".", ",", "..", "«", "'s", "'", "1", "²", " ", "\n", "\x1c", "\xa0", "日", "Σ", "\u0301", "é,", "À.", "ā.", "×.", "²,"]
    draw = np.random.default_rng(3)
    texts = ["".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 12))) for _ in range(3000)]
    few = packing.WordTokenizer(spec, packing.WORD_PATTERN, limit=20_000)  # generations change often
    for kind in (pa.string(), pa.large_string()):
        rows = pa.array(["before.", *texts], kind)[1:]
        got = [b for at in range(0, len(rows), 250) for b in few.encode_all(rows[at : at + 250])]
        assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_remembered_words_stay_small_and_other_work_drops_them():
    import tracemalloc

    import pyarrow as pa

    from starfold.llm import common

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = packing.WordTokenizer(f.read(), packing.WORD_PATTERN)
    count = 60_000
    texts = pa.array([" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}" for i in range(at, at + 1000)) for at in range(0, count, 1000)])
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    first = list(map(zlib.crc32, words.encode_all(texts)))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(set(words.known)) == count + 1 and held < 60 * count
    assert list(map(zlib.crc32, words.encode_all(texts))) == first

    common.worker_memory(("test", "words"), lambda: words)
    assert list(common.lean(iter, keeps=True)(iter([1]))) == [1]
    assert common.worker_memory(("test", "words"), object) is words
    assert list(common.lean(iter)(iter([1]))) == [1]
    assert common.worker_memory(("test", "words"), object) is not words
    common.worker_memory(("test",), object)


def test_packing_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from starfold.llm import queries

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*TEXTS, "see <|endoftext|> here", "x<|startoftext|>Y<|endoftext|>", "<|ENDOFTEXT|> <|endoftext| >", "é<|endoftext|>日本語", "<|ENDOFTEXT|> 日本", "a\x1c<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    expected = {}
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            expected[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    assert expected[len(TEXTS), 0][1] == 4
    for out in (queries.op9_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out.collect()} == expected


def test_packing_is_gapless_and_near_the_bound(spark):
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in rng.integers(1, 900, 3000)] + [4096] * 5
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)] + [(9001, None), (9002, 0), (9003, 5000)], "id int, length long").withColumns({"_group": F.lit("own"), "OFFSET": F.lit(1)})
    out = packing.pack(rows, groups=5, merge=5).collect()
    bins = {}
    for r in out:
        if r["id"] >= 9000:
            assert r["sequence_id"] is None
        else:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts)) and parts[-1][0] + parts[-1][1] <= 4096
    assert sum(len(p) for p in bins.values()) == len(lengths)
    assert len(bins) <= -(-sum(lengths) // 4096) + 2


def test_bin_completion_beats_best_fit():
    lengths = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2] * 3
    found = packing.bin_completion(lengths, 9)
    assert sorted(x for b in found for x in b) == sorted(lengths) and all(sum(b) <= 9 for b in found)
    assert len(found) <= len(packing.best_fit(lengths, 9))
    assert packing.bin_completion([4, 4, 4, 3, 3, 3, 3, 3, 3], 10) and len(packing.bin_completion([5, 4, 4, 3, 3, 2, 2, 1], 8)) == 3


def fewest_bins(lengths, capacity):
    least = len(lengths)

    def place(i, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if i == len(lengths):
            least = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= lengths[i]:
                place(i + 1, [*rooms[:j], room - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return least


def test_bin_completion_equals_trying_everything():
    rng = random.Random(5)
    worse = 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 50, 100])
        lengths = sorted((rng.randrange(max(1, capacity // rng.choice([4, 8, 20])), capacity // rng.choice([1, 2]) + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        found, proven = packing.proven_bins(lengths, capacity)
        assert sorted(x for b in found for x in b) == sorted(lengths) and all(sum(b) <= capacity for b in found)
        assert proven and len(found) == fewest_bins(lengths, capacity)
        worse += len(packing.best_fit(lengths, capacity)) > len(found)
    assert worse  # the search is needed
    lengths = [rng.randrange(900, 1900) for _ in range(300)]
    found, proven = packing.proven_bins(lengths, 4096, steps=50)
    assert len(found) <= len(packing.best_fit(lengths, 4096)) and (not proven or len(found) >= -(-sum(lengths) // 4096))


def test_packing_takes_repeated_rows_and_empty_tables(spark):
    rows = spark.range(9000).select(F.lit(7).alias("doc_id"), F.lit(1500).cast("long").alias("length"))
    out = packing.pack(rows, groups=4, spread=("doc_id",))
    assert out.groupBy("sequence_id").count().agg(F.max("count"), F.count("*")).first()[:] == (2, 4500)
    assert out.filter("not proven").count() == 0
    assert packing.pack(rows.limit(0), groups=1).count() == 0
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        assert packing.pieces(spark.createDataFrame([], "doc_id long, text string"), f.read()).count() == 0


def labeled(spark):
    word = lambda i, k: f"word{(i * 7 + k * 13) % 40}"
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = " ".join(word(i, k) for k in range(30))
        rows.append((i, f"{text} idiot{i % 2} {text}" if bad else text, "l", None))
        labels.append((i, 0 if bad else 1, 1 if bad else 0))
    rows += [(None, "text", None, None), (900, None, None, None), (901, "", "l", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (1000, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_takes_any_text(spark):
    docs, labels = labeled(spark)
    model = toxicity.fit(docs, labels.filter("doc_id < 300"), ftrl=toxicity.Ftrl(l1=1.0), bits=16)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(out) == 403 and all(0 <= s <= 1 for s in out.values())
    assert all((out[i] >= 0.5) == (i % 3 == 0) for i in range(300, 400))
    assert len(model.slots) < 2000
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, empty).agg(F.max("score")).first()[0] == 0.5


def test_quality_learns_and_takes_any_text(spark):
    docs, labels = labeled(spark)
    shouting = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")))
    model = quality.fit(shouting, labels.filter("doc_id < 300"), indexing=quality.Indexing(slots=1024, width=16))
    out = {r["doc_id"]: r["score"] for r in quality.score(shouting, model).collect()}
    assert len(out) == 403 and all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= 0.5) == (i % 3 != 0) for i in range(300, 400)]) > 0.95
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).agg(F.min("score")).first()[0] == 0.5


def test_language_mixtures(spark):
    a, b = "the cat sat on the mat and the dog ran to the man ", "der hund und die katze sind nicht in dem haus und "
    rows = [(i, a * 3 if i % 2 else b * 3, "en" if i % 2 else "de", None) for i in range(60)]
    docs = spark.createDataFrame([*rows, (90, None, "en", None), (91, "12 34 !!", None, None), (92, a * 5 + b * 5, None, None), (93, "", "de", None)], "doc_id long, text string, lang string, Languages string")
    model = langid.fit(docs)
    out = {r["doc_id"]: r["found"] for r in langid.identify(docs, model, out="found").collect()}
    assert all(out[i][0]["lang"] == ("en" if i % 2 else "de") for i in range(60))
    assert out[90] == out[91] == out[93] == []
    assert {x["lang"] for x in out[92]} == {"en", "de"} and all(0.3 < x["share"] < 0.7 for x in out[92])
    assert langid.identify(docs, langid.fit(docs.limit(0)), out="found").filter(F.size("found") > 0).count() == 0
