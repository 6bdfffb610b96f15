"""Joins, deduplication and search against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from starfold.llm import common, embedding_dedup, jaccard, nearest, repeats
from starfold.llm.components import connected_components, smallest_reachable
from starfold.llm.vectors import chi_square_cdf, chi_square_quantile


def components(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def test_connected_components(spark):
    links = [(1, 2), (3, 2), (5, 4), (4, 4), (7, 8), (8, 9), (9, 10), (10, 11), (2, 1), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    chain = np.arange(200)
    node, root = smallest_reachable(chain[:-1], chain[1:])
    assert (root == 0).all() and len(node) == 200


def test_components_of_random_links_in_few_tasks(spark):
    """A link is read once for its two ends: no stage of a round has twice the partitions; results as by brute force."""
    rng = random.Random(21)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k + 1, k) for k in range(1000, 1060)]
    tasks, found = stages_of(spark, lambda: {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(40), "a", "b").groupBy("node", "component").count().collect()})
    assert found == components({n for a, b in links if a != b for n in (a, b)}, links)
    assert tasks.count(2 * 6) <= 1  # the result's own union


def stages_of(spark, work):
    """The number of tasks of every stage that the work ran, and what it returned; no partitions are merged meanwhile."""
    group, held = f"stages-{random.random()}", {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        seen = spark.sparkContext.statusTracker()
        infos = [seen.getStageInfo(s) for job in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(job).stageIds]
        return [i.numTasks for i in infos if i and i.numCompletedTasks], out
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)


def family_texts(rng):
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 120))] for _ in range(12)]
    texts = []
    for _ in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(1, len(words) // 25 + 2))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append(rng.choice([" ", "\n"]).join(words))
    return [*texts, *texts[:20], "", None, "One two", "one TWO", " \t "]


@pytest.mark.parametrize("num,den,width", [(85, 100, 4), (8, 10, 5), (1, 2, 2)])
def test_jaccard_join_is_exact(spark, num, den, width, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 900)  # families go in blocks
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)  # and so do the sets of a signature
    texts = family_texts(random.Random(num))
    docs = spark.createDataFrame([(i * 3, t, "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None)], "doc_id long, text string, size string, part int")
    sets = {}
    for i, t in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i * 3] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    expected = components(sets, links)
    out = [r for r in jaccard.join_components(docs, jaccard.Threshold(num, den), width).collect()]
    assert len(out) == len(texts) + 1
    for r in out:
        if r["doc_id"] is not None:
            assert r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == expected[r["doc_id"]]
    assert jaccard.join_components(docs.limit(0), jaccard.Threshold(num, den), width).count() == 0


def test_jaccard_parts_follow_the_texts(spark, monkeypatch):
    """Small texts go in the session's shuffle partitions, not in a multiple of them; large ones in as many as they ask for, with the same rows."""
    texts = family_texts(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    run = lambda: sorted(map(tuple, jaccard.join_components(docs, jaccard.Threshold(85, 100), 4).collect()))
    few, found = stages_of(spark, run)
    assert 2 <= len(few) and max(few) <= 2 * 6
    monkeypatch.setattr(jaccard, "PART_BYTES", -(-sum(len((t or "").encode()) for t in texts) // 19))
    more, again = stages_of(spark, run)
    assert 19 in more and again == found


def test_meetings_are_named_together(monkeypatch):
    """Thousands of meetings take a few passes over arrays, not some for each; the same groups as by a plain grouping."""
    rng = np.random.default_rng(31)
    signs, sets = rng.integers(0, 9000, 40_000).astype(np.uint32), rng.integers(-(2**62), 2**62, 3000)[rng.integers(0, 3000, 40_000)]
    signs, sets = np.append(signs, [20_000] * 12 + [30_000] * 2), np.append(sets, [*range(12), 1, 2])
    passes = []
    monkeypatch.setattr(jaccard, "mix64", lambda x, mix=common.mix64: passes.append(1) or mix(x))
    groups = {}
    for sign, name in zip(signs.tolist(), sets.tolist(), strict=True):
        groups.setdefault(sign, set()).add(name)
    expected = {tuple(sorted(g)) for g in groups.values() if len(g) > 1}
    found = list(jaccard.meetings(signs, sets))
    assert len(found) == len(expected) > 5000 and {tuple(m.tolist()) for _, m in found} == expected
    assert len(passes) < 10
    assert all(name == jaccard.set_key(m.view(np.uint64)) for name, m in found[:50])
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    pairs = {frozenset(p) for _, m in jaccard.meetings(signs[-14:], sets[-14:]) for p in np.array(np.meshgrid(m, m)).reshape(2, -1).T.tolist()}
    assert all(frozenset((a, b)) in pairs for a in range(12) for b in range(12))
    assert list(jaccard.meetings(np.arange(3, dtype=np.uint32), np.arange(3))) == list(jaccard.meetings(np.empty(0, np.uint32), np.empty(0, np.int64))) == []


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(4)
    t = jaccard.Threshold(85, 100)
    for size in (3, 7, 12, 13, 25, 60, 150, 700):
        for _ in range(30):
            common = rng.integers(0, 2**63, size, dtype=np.uint64)
            extra = rng.integers(0, 2**63, max(1, int(size * 0.17)), dtype=np.uint64)
            cut = rng.integers(0, len(extra) + 1)
            a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
            both = len(np.intersect1d(a, b))
            if t.linked(both, len(a), len(b)) and not np.array_equal(a, b):
                assert len(np.intersect1d(jaccard.signatures(a, t), jaccard.signatures(b, t)))


def test_sets_are_hashed_and_signed_by_batches(monkeypatch):
    """A batch of 400 texts takes as many passes over arrays as its size bands ask for, not as its texts do, with each text's own results."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Aa", "b", "\xe9\x1c", "long-word-of-bytes", "\0"]) + str(rng.randrange(300)) for _ in range(rng.choice([0, 1, 3, 4, 60, 61, 300]))) for _ in range(396)]
    texts += [None, "", " \t\n\x0b\f\r ", "x" * 100_000 + " Y"]
    passes = []
    for module in (common, jaccard):
        monkeypatch.setattr(module, "mix64", lambda x, mix=common.mix64: passes.append(1) or mix(x))
    t = jaccard.Threshold(85, 100)
    column = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    elements, sizes = common.shingle_sets(column, 4)
    names = jaccard.set_keys(elements, sizes)
    signs, places = jaccard.signatures_of(elements, sizes, t, 1.5)
    assert len(passes) < 120
    known, sets = {}, np.split(elements, np.cumsum(sizes)[:-1])
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        shingles = frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()
        assert len(sets[i]) == len(shingles) and (sets[i][1:] > sets[i][:-1]).all()
        assert known.setdefault(shingles, sets[i].tolist()) == sets[i].tolist()
        assert np.array_equal(common.shingle_sets(column.slice(i, 1), 4)[0], sets[i]) and jaccard.set_key(sets[i]) == names[i]
        assert np.array_equal(np.unique(signs[places == i]), jaccard.signatures(sets[i], t, 1.5))
    assert len(set(map(tuple, known.values()))) == len(known)
    part, blobs = jaccard.packed_signatures(signs, places, names, 5)
    found = {(p, s, n) for p, blob in zip(part.tolist(), blobs, strict=True) for s, n in zip(*(c.tolist() for c in jaccard.unpacked_signatures(blob)), strict=True)}
    assert found == {(s % 5, s // 5 % 2**32, n) for s, n in zip(signs.tolist(), names[places].tolist(), strict=True)}


def test_batches_end_by_rows_and_by_bytes():
    batch = pa.record_batch([pa.array(["xxx", None, "y" * 9, "", "z"])], names=["text"])
    assert [b.num_rows for b in common.small(iter([batch, batch.slice(1, 3), batch.slice(0, 0)]), 100, heavy=0, most=5)] == [2, 1, 2, 1, 1, 1]
    assert [b.num_rows for b in common.small(iter([batch]), 2, heavy=0)] == [b.num_rows for b in common.small(iter([batch]), 2)] == [2, 2, 1]


def test_histograms_never_part_a_linked_pair():
    rng = np.random.default_rng(6)
    t = jaccard.Threshold(8, 10)
    for size in (1, 5, 16, 17, 40, 300, 3000):
        for _ in range(20):
            common = rng.integers(0, 2**64, size, dtype=np.uint64)
            extra = rng.integers(0, 2**64, max(1, int(size * rng.random() * 0.6)), dtype=np.uint64)
            cut = rng.integers(0, len(extra) + 1)
            a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:]]))
            pairs = jaccard.possible_forest([jaccard.histogram(a), jaccard.histogram(b)], np.array([len(a), len(b)]), t)
            if t.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert pairs == [(0, 1)]
    far = [np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64)) for _ in range(5)]
    assert jaccard.possible_forest([jaccard.histogram(f) for f in far], np.full(5, 200), t) == []


def removed_by_brute_force(texts, length):
    seen, out = set(), {}
    for key in sorted(texts):
        data = texts[key]
        mask = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                mask[s : s + length] = True
            seen.add(w)
        out[key] = mask
    return out


@pytest.mark.parametrize("anchor_runs", [20_000, 1])
def test_repeats_are_exact(spark, anchor_runs):
    rng = random.Random(anchor_runs)
    parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(5, 300))) for _ in range(8)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 6))) for _ in range(60)] + ["a" * 700, "ab" * 400, "short", "", None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, parts[0] * 3, 2), (0, texts[0], 3)], "doc_id long, text string, kind int")
    expected = removed_by_brute_force({i: (t or "").encode() for i, t in enumerate(texts)}, 40)
    out = repeats.remove_repeats(docs, length=40, gram=16, anchor_runs=anchor_runs).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r["doc_id"] is None:
            assert r["spans"] == []
            continue
        data = (texts[r["doc_id"]] or "").encode()
        mask = expected[r["doc_id"]]
        got = np.zeros(len(data), bool)
        for s in r["spans"]:
            got[s["begin"] : s["end"]] = True
        assert (got == mask).all() and bytes(r["kept"]) == np.frombuffer(data, np.uint8)[~mask].tobytes()
    whole = repeats.remove_repeats(docs, length=40, gram=16, whole_characters=True).collect()
    assert all(bytes(r["kept"]).decode() is not None for r in whole)
    assert repeats.remove_repeats(docs.limit(0), length=40, gram=16).count() == 0


@pytest.mark.parametrize("anchor_runs", [20_000, 1])
def test_rows_of_one_key_with_other_texts_are_documents_of_their_own(spark, anchor_runs):
    """The plain version orders documents by key and by the digest of their text."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    a, b, c = text(330), text(330), text(90)
    rows = [(1, a), (2, a), (2, b), (3, b + c), (3, c + a[:200]), (3, c), (3, b + c), (4, a[50:150] + text(40)), (4, b), (2, b), (None, a), (5, None), (5, c * 3)]
    names = {(i, t): (i, repeats._tag((t or "").encode())) for i, t in rows if i is not None}
    expected = removed_by_brute_force({n: (t or "").encode() for (i, t), n in names.items()}, 100)
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int, `n.bytes` string").repartition(3)
    out = repeats.remove_repeats(docs, anchor_runs=anchor_runs, carry=["row", "n.bytes"]).collect()
    assert sorted(r["row"] for r in out) == list(range(len(rows))) and all(r["n.bytes"] == "x" for r in out)
    for r in out:
        i, t = rows[r["row"]]
        data = np.frombuffer((t or "").encode(), np.uint8)
        keep = ~expected[names[i, t]] if i is not None else np.ones(len(data), bool)
        assert r["doc_id"] == i and bytes(r["kept"]) == data[keep].tobytes(), r["row"]
    kept = {r["row"]: bytes(r["kept"]).decode() for r in out}
    assert kept[0] == a and kept[1] == "" and kept[2] == b  # the text that repeats nothing is whole


def test_deep_shallow_sorting_sorts():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 120))) for _ in range(300)] + [b"ab" * 40 + bytes([60 + i % 5]) for i in range(30)] + [b"ab" * 40] * 3
    order, common = repeats.deep_shallow_sort(strings)
    assert [strings[i] for i in order] == sorted(strings)
    assert all(strings[order[k]][: common[k]] == strings[order[k - 1]][: common[k]] for k in range(1, len(order)))


def vectors_table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[50:120] = x[50] + rng.normal(size=(70, 16)) * 0.1
    x[200:210] = x[200]
    rows = [(i, x[i].tolist(), i % 3 if not 50 <= i < 120 else 1, "r") for i in range(n)]
    rows += [(1000, None, 1, None), (1001, [0.0] * 16, 1, None), (1002, [float("nan")] * 16, 1, None), (1003, [None] + [1.0] * 15, 1, None), (1004, x[0].tolist(), None, None), (None, x[0].tolist(), 0, None), (1005, [1.0, 2.0], 1, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank string"), x


@pytest.mark.parametrize("part,block", [(16_000, 4000), (20, 3)])
def test_nearest_against_brute_force(spark, monkeypatch, part, block):
    monkeypatch.setattr(nearest, "CELL_ROWS", 64)
    monkeypatch.setattr(nearest, "PART_ROWS", part)  # cells go in parts
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)  # and so do their queries
    table, x = vectors_table(spark)
    full = np.vstack([x, x[0]])
    ids = np.array([*range(len(x)), 1004])
    out = nearest.search(table, table.filter("vec_id % 10 = 0"), k=5).toPandas()
    hits = total = 0
    for q in range(0, len(x), 10):
        d = np.sqrt(((full - x[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:5]]
        got = out[out.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == [1, 2, 3, 4, 5] and got.score.is_monotonic_increasing
        hits += len(set(best) & set(got.vec_id))
        total += 5
    assert hits / total >= 0.95
    assert set(out.query_id) == set(range(0, len(x), 10))
    assert nearest.search(table.limit(0), table.limit(0)).count() == 0
    few = table.filter("vec_id < 3")
    assert nearest.search(few, few, k=5).count() == 6


def test_nearest_takes_many_equal_vectors(spark, monkeypatch):
    """A third of the rows in one point: they are dealt to parts, and ties go by the smaller key."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 50)
    monkeypatch.setattr(nearest, "PART_ROWS", 30)
    x = np.random.default_rng(4).normal(size=(400, 8))
    x[100:240] = x[100]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = nearest.search(table, table.filter("vec_id IN (100, 239, 7)"), k=4).toPandas()
    got = {q: g.sort_values("rank")["vec_id"].tolist() for q, g in out.groupby("query_id")}
    assert got[100] == [101, 102, 103, 104] and got[239] == [100, 101, 102, 103]
    d = np.sqrt(((x - x[7]) ** 2).sum(axis=1))
    d[7] = np.inf
    assert len(set(got[7]) & set(np.lexsort((np.arange(400), d))[:4].tolist())) >= 3


def test_rows_of_one_key_with_other_vectors_are_rows_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 50)
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 0.0, 1.1]), (9, [0.0, 0.0, 1.0]), (7, [0.0, 1.0, 0.9]), (9, [0.0, 0.0, 1.0])]
    out = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[2:3], "vec_id long, embedding array<double>"), k=10).collect()
    got = [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in sorted(out, key=lambda r: r["rank"])]
    assert got == [(1, 5, 0.1), (2, 7, round(np.sqrt(1.01), 6)), (3, 5, round(np.sqrt(2), 6))]
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    ids = np.arange(300) // 2  # each id has two vectors
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    out = nearest.search(table, table.filter("vec_id % 50 = 0"), k=4, confidence=0.9999).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in out)
    expected = []
    for q in np.flatnonzero(ids % 50 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        expected += [(int(ids[q]), k + 1, int(ids[i]), round(float(d[i]), 9)) for k, i in enumerate(np.lexsort((ids, d))[:4])]
    assert len(set(found) & set(expected)) >= 0.95 * len(expected) and len(found) == len(expected)


def test_tree_verifies_neighbours_until_the_test_holds():
    """With projections that keep every distance, the search is exact and ends early."""
    x = np.random.default_rng(5).normal(size=(3000, 3))
    tree = nearest.Tree(np.arange(3000), np.arange(3000), x, x)
    for q in range(0, 3000, 300):
        found, distance = tree.nearest(q, x[q], x[q], 5, 1.0, 1e300)
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert found.tolist() == np.argsort(d)[:5].tolist() and np.allclose(distance, np.sort(d)[:5])


def test_chi_square():
    assert chi_square_cdf(3.841459, 1) == pytest.approx(0.95, abs=1e-6)
    assert chi_square_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-4)


def test_embedding_links_against_brute_force(spark):
    table, _ = vectors_table(spark)
    rows = [r for r in table.collect()]
    out = [r for r in embedding_dedup.near_duplicates(table, least=0.93).collect()]
    assert len(out) == len(rows)
    good = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in rows if r["vec_id"] is not None and r["vec_id"] < 1000]
    unit = {i: v / np.linalg.norm(v) for i, v, _ in good}
    links = [(a, b) for a, _, la in good for b, _, lb in good if a < b and la == lb and unit[a] @ unit[b] >= 0.93]
    least = components(list(unit), links)
    degree = {i: sum(i in e for e in links) for i in unit}
    missing = 0
    for r in out:
        i = r["vec_id"]
        if i in unit:
            assert r["component_id"] == least[i] and r["n_links"] <= degree[i] and r["kept"] == (i == least[i])
            missing += degree[i] - r["n_links"]
        elif i is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    assert missing <= 0.05 * 2 * len(links)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def degrees_and_components(x, labels, least=0.93):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = (unit @ unit.T >= least) & (labels[:, None] == labels)
    np.fill_diagonal(hits, False)
    a, b = np.nonzero(hits)
    root = dict(zip(*(v.tolist() for v in smallest_reachable(a, b)), strict=True))
    return hits, [root.get(i, i) for i in range(len(x))]


def hot_table(spark, copies=500, rest=300, seed=5):
    """A label of near copies, which draw several centroids, pairs, and single vectors; and a small label."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(copies + 2 * rest, 16))
    x[:copies] = x[0] + rng.normal(size=(copies, 16)) * 0.14
    x[copies + rest :] = x[copies : copies + rest] + rng.normal(size=(rest, 16)) * 0.1
    labels = np.where(np.arange(len(x)) % 40 == 39, 2, 1)
    return spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int"), x, labels


def test_embedding_links_cross_regions_and_shards(spark, monkeypatch):
    table, x, labels = hot_table(spark)
    hits, component = degrees_and_components(x, labels)
    monkeypatch.setattr(embedding_dedup, "REGION_ROWS", 150)
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 60)
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}
    degree = hits.sum(axis=1)
    assert len(out) == len(x) and all(out[i]["n_links"] <= degree[i] for i in out)
    assert sum(r["n_links"] for r in out.values()) >= 0.99 * degree.sum()
    assert [out[i]["component_id"] for i in range(len(x))] == component


def test_no_region_with_a_link_is_left_out():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 8))
    x[500:1000] = x[0] + rng.normal(size=(500, 8)) * 0.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for count in (2, 7, 30):
        centre = embedding_dedup.centroids(unit, count)
        own = embedding_dedup.nearest_centroids(unit, centre, 1)[:, 0]
        near = embedding_dedup.reached(unit, centre, 0.93)
        a, b = np.nonzero(unit @ unit.T >= 0.93)
        assert near[a, own[b]].all() and not near.all()


def test_embedding_audit_sees_small_groups(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16))
    x[:300] = x[0] + rng.normal(size=(300, 16)) * 0.05
    x[400:] = x[300:400] + rng.normal(size=(100, 16)) * 0.05  # pairs: 200 of 89,900 links
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    search = embedding_dedup.Graph.in_range
    hits, _ = degrees_and_components(x, np.ones(len(x)))
    monkeypatch.setattr(embedding_dedup.Graph, "in_range", lambda *a: found if len(found := search(*a)) > 20 else found[:0])
    found = embedding_dedup.search_region(unit, 0.93, 24, 1000, 200, 0.95)
    assert (found == hits).all()


def test_embedding_links_found_one_way_count_at_both_ends(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 16))
    x[100:] = x[:100] + rng.normal(size=(100, 16)) * 0.1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    search = embedding_dedup.Graph.in_range
    monkeypatch.setattr(embedding_dedup.Graph, "in_range", lambda self, node, *a: (found := search(self, node, *a))[found > node])
    found = embedding_dedup.search_region(unit, 0.93, 24, 1000, 0, 0.95)
    hits, _ = degrees_and_components(x, np.ones(len(x)))
    assert (found == found.T).all() and (found == hits).all()


def test_embedding_tasks_stay_bounded(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1300, 16))
    x[:1000] = x[0] + rng.normal(size=(1000, 16)) * 1e-3
    monkeypatch.setattr(embedding_dedup, "REGION_ROWS", 200)
    monkeypatch.setattr(embedding_dedup, "centroids", lambda vectors, count: x[999:999 + count] / np.linalg.norm(x[999:999 + count], axis=1, keepdims=True))
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    distinct = table.selectExpr("label", "embedding as vector", "vec_id as id", "vec_id as node", "1L as weight")
    sizes = embedding_dedup.deal(distinct, 0.93).groupBy("low", "high").count().toPandas()
    alone = sizes[sizes.low == sizes.high]["count"]
    assert alone.sum() == len(x) and alone.max() <= 300 and sizes["count"].max() <= 600
    hits, component = degrees_and_components(x, np.ones(len(x)))
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert [out[i]["n_links"] for i in range(len(x))] == hits.sum(axis=1).tolist()
    assert [out[i]["component_id"] for i in range(len(x))] == component


def test_links_of_near_copies_take_no_pairs():
    hits = ~np.eye(3000, dtype=bool)
    rows = np.arange(3000)
    links = embedding_dedup.Links(np.full(3000, 2))
    tracemalloc.start()
    links.add(rows, rows, hits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links.counts == 5998).all() and (links.root == 0).all() and peak < 40e6  # 9 million pairs of longs are 144 MB
