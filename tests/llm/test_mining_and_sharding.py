"""Hard negatives, collocations and sharding, against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from starfold.llm import collocations, hard_negatives, sharding

SF = "/root/testdata/sf0.001"


# --- hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=5, low=80):
    """Rows of (anchor, positive, rank, negative, positive score, negative score), all pairs compared."""
    good = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), k) for i, v, k in rows if None not in (i, v, k) and None not in v and all(np.isfinite(v)) and max(map(abs, v)) < 2**18}
    found = []
    for a in good:
        if not is_anchor(a[0]):
            continue
        score = lambda b: sum(x * y for x, y in zip(a[1], b[1], strict=True))  # noqa: B023, E731
        order = lambda b: (-score(b), b[0])  # noqa: B023, E731
        for p in sorted((b for b in good if b != a and b[2] == a[2]), key=order)[:positives]:
            fits = sorted((b for b in good if b[2] != a[2] and low * score(p) <= 100 * score(b) <= 100 * score(p)), key=order)[:negatives]
            found += [(a[0], p[0], rank, b[0], score(p), score(b)) for rank, b in enumerate(fits, 1)]
    return sorted(found)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, "other", 1) for r in rows], "vec_id long, embedding array<float>, label int, score string, `a.b` int")
    found = hard_negatives.mine(table, table.filter("vec_id % 4 = 0"), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 60)  # several parts
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)  # and blocks
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=6)
    rows = [(i, (centre + rng.normal(size=6) * (0.02 if i % 3 else 1)).round(seed + 1).tolist(), int(rng.integers(3))) for i in range(200)]
    rows += rows[:20]  # repeated rows
    rows += [(i + 500, v, k) for i, v, k in rows[:30]]  # ties: equal vectors under other ids
    rows += [(8, [0.5] * 6, 1), (8, [0.25] * 6, 1)]  # one id, several vectors
    rows += [(900, [0.0] * 6, 0), (904, [0.0] * 6, 1), (None, [1.0] * 6, 0), (908, None, 0), (912, [1.0] * 6, None), (916, [1.0, None] * 3, 0), (920, [float("nan")] * 6, 0), (924, [float("inf")] * 6, 0), (928, [1e30] * 6, 0), (932, [1.0], 0)]
    expected = plain_negatives([r for r in rows if r[1] is None or len(r[1]) == 6], lambda i: i % 4 == 0)
    assert len(expected) > 100
    assert mined(spark, rows) == expected


def test_few_rows_and_no_rows(spark):
    rows = [(4, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.9, 0.9], 1), (3, [0.1, 0.1], 1), (6, [-1.0, -1.0], 0)]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 4 == 0) == [(4, 1, 1, 2, 131072, 117760)]
    assert mined(spark, []) == []
    assert mined(spark, [(4, None, 1)]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(1, 5), st.integers(1, 4))
def test_reading_stops_only_when_all_is_found(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-spread, spread + 1, size=(n, width))
    labels, ids = rng.integers(0, 2, n), rng.permutation(n)
    lists = hard_negatives.Lists(ids.astype(np.int64), ids.astype(np.int64), labels.astype(np.int64), vectors.astype(np.int64))
    anchor = rng.integers(-spread, spread + 1, size=width)
    scores = vectors @ anchor
    rows, values = lists.positives(-1, 0, anchor, 3)
    same = [i for i in range(n) if labels[i] == 0]
    assert ids[rows].tolist() == [ids[i] for i in sorted(same, key=lambda i: (-scores[i], ids[i]))[:3]]
    windows = [(-2, 3), (0, 0), (5, 4), (1, 100)]
    for (low, high), (rows, values) in zip(windows, lists.negatives(0, anchor, windows, 3), strict=True):
        fits = [i for i in range(n) if labels[i] == 1 and low <= scores[i] <= high]
        assert ids[rows].tolist() == [ids[i] for i in sorted(fits, key=lambda i: (-scores[i], ids[i]))[:3]]
        assert values.tolist() == scores[rows].tolist()


def test_reading_stops_early_on_the_lists():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-5, 6, size=(4000, 4))
    vectors[:20] = 200
    lists = hard_negatives.Lists(np.arange(4000), np.arange(4000), np.zeros(4000, int), vectors)
    met = 0
    for rows, scores, threshold in lists.read(np.array([1, 1, 1, 1])):
        met += len(rows)
        if threshold < 800:
            break
    assert met < 400  # of 4000
    assert lists.positives(-1, 0, np.array([1, 1, 1, 1]), 5)[0].tolist() == [0, 1, 2, 3, 4]


def test_large_components_are_exact():
    x = 2**26 - 1
    vectors = np.array([[x, x - 1], [x, x]])
    lists = hard_negatives.Lists(np.arange(2), np.arange(2), np.zeros(2, int), vectors)
    assert lists.vectors.dtype == np.int64
    assert lists.positives(-1, 0, vectors[1], 2)[1].tolist() == [2 * x * x, 2 * x * x - x]


def test_op11(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table]
    found = entry.queries()["op11_hard_negatives"](spark, SF).collect()
    assert sorted(map(tuple, found)) == plain_negatives(rows, lambda i: i % 100 == 0)


# --- collocations


def plain_collocations(docs, least, longest, top, covered=80):
    words, counts = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        f = {p: c for p, c in f.items() if c >= least}
        rows = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = (q for q in f if len(q) > len(p) and any(q[s : s + len(p)] == p for s in range(len(q))))
            if not any(100 * f[q] >= covered * a for q in longer):
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def found_collocations(spark, docs, **options):
    table = spark.createDataFrame([(i, *d, 1, "x") for i, d in enumerate(docs)], "doc_id long, lang string, text string, n int, phrase string").repartition(5)
    return sorted(map(tuple, collocations.collocations(table, **options).collect()))


def corpus(seed, docs):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "a", "é", "ß", "x-y", "don't", " ", "\x00", "\x1c", "\x85", "Ä", "9", "#", *(f"w{i}" for i in range(20))]
    phrases = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 6))] for _ in range(12)]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randrange(40)):
            parts += rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(vocabulary)]
            parts.append(rng.choice(["", "", "", ".", ",", "\n", "\r", "?"]))
        out.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "\t", "  "]).join(parts)))
    return out


@pytest.mark.parametrize("least,longest,top", [(3, 4, 40), (30, 4, 2000), (12, 3, 5), (1, 2, 10**6)])
def test_collocations_equal_plain_counts(spark, least, longest, top, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 200)
    monkeypatch.setattr(collocations, "HELD", 150)
    monkeypatch.setattr(collocations, "FILTER_BITS", 12)  # so small that many phrases share a place
    docs = corpus(least, 120) + [("en", None), ("en", ""), ("fr", " \t.\n"), (None, "one"), ("und", "one two"), *[("en", "same old text same old text")] * 40]
    expected = plain_collocations(docs, least, longest, top)
    assert len(expected) > 10
    assert found_collocations(spark, docs, least=least, longest=longest, top=top) == expected


def test_collocations_of_nothing_and_of_a_long_text(spark):
    assert found_collocations(spark, [], least=2) == []
    assert found_collocations(spark, [("en", None), ("de", "")], least=1) == []
    long = [("en", "a b c " * 200_000), ("en", "x" * 3_000_000 + " a b")]
    assert found_collocations(spark, long, least=1000, longest=2) == plain_collocations(long, 1000, 2, 2000)


def test_counts_past_64_bits_score_exactly(spark):
    """The same expression as in ``collocations``, of counts whose product passes 64 bits."""
    a, left, right = 9 * 10**15, 10**16, 10**16 + 7
    sql = "cast(2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)"
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"{sql} AS s").first()["s"]
    assert got == 2000000 * a // (left + right) == int(Decimal(2000000 * a) // Decimal(left + right))


def test_op12(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = entry.queries()["op12_collocations"](spark, folder).collect()
    assert sorted(map(tuple, found)) == plain_collocations(docs, 30, 4, 2000)


# --- sharding


def dealt(spark, rows, shards, schema="doc_id long, source string, text string, SHARD int, slot string", **options):
    found = sharding.interleave(spark.createDataFrame(rows, schema).repartition(3), shards, **options)
    assert found.columns == ["doc_id", "source", "text", "shard", "slot"]
    return found.collect()


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_even_and_match_the_mixture(spark, hot, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 16)
    if hot:
        monkeypatch.setattr(sharding, "HOT_ROWS", 20)
        monkeypatch.setattr(sharding, "HOT_BITS", 30)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, ""]), None if i % 50 == 0 else f"t{i}", 1, "x") for i in range(900)]
    rows += [(None, "a", "copy", 1, "x")] * 300 + [(7, "b", "same", 1, "x")] * 30  # a third of all rows is one row
    found = dealt(spark, rows, 13)
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in found) == Counter(r[:3] for r in rows)
    sizes = Counter(r["shard"] for r in found)
    assert set(sizes) == set(range(13)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    for source, n in Counter(r[1] for r in rows).items():
        own = Counter(r["shard"] for r in found if r["source"] == source)
        assert all(abs(own[s] - n / 13) <= 2 for s in range(13)), source


def test_the_layout_of_the_table_and_its_other_columns_do_not_matter(spark):
    rows = [(i, f"s{i % 3}", f"t{i}", 0, "") for i in range(500)]
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in dealt(spark, rows, 7)}
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in dealt(spark, rows[::-1], 7)}
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in dealt(spark, rows, 7, seed=14)}
    assert first == again != other


def test_few_rows_and_none(spark):
    assert dealt(spark, [], 4) == []
    assert [(r["shard"], r["slot"]) for r in dealt(spark, [(None, None, None, None, None)], 40)] == [(0, 0)]
    found = dealt(spark, [(i, "a", "x" * 10**6, 0, "") for i in range(3)], 40)
    assert len({r["shard"] for r in found}) == 3 and {r["slot"] for r in found} == {0}
    with pytest.raises(ValueError, match="at least 1"):
        dealt(spark, [], 0)


def test_written_shards_read_back_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 2}") for i in range(200)], "doc_id long, source string")
    found = sharding.interleave(rows, 4)
    sharding.write_shards(found, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in found.collect())


def test_op13(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op13_sharding"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["slot"] < sizes[r["shard"]] for r in rows)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(texts)
