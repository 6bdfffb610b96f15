"""The registered queries themselves, on given tables, against plain versions of what their contracts say."""

import re
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

import __spark_entry__ as entry
from starfold.llm import bpe, token_counts

SF = "/root/testdata/sf0.001"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def run(spark):
    return lambda name, folder=SF: entry.queries()[name](spark, folder).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def components(nodes, links):
    least = {n: n for n in nodes}

    def top(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        least[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_op1(run, texts):
    ranks = {}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        for line in f.read().splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run("op1_bpe_roundtrip")
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op2_recall_and_scores(spark, run):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in table if r["embedding"] is not None and None not in r["embedding"]}
    x = {k: v for k, v in x.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(x))
    matrix = np.array([x[k] for k in ids])
    rows = run("op2_nearest", folder)
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {k for k in x if k % 100 == 0}
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((matrix - x[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        assert sorted(got) == list(range(1, 11))
        near = [got[k] for k in range(1, 11)]
        assert near == sorted(near, key=lambda v: (v[1], v[0]))
        assert all(abs(s - d[np.searchsorted(ids, v)]) < 1e-9 for v, s in near)
        hits += len(set(best.tolist()) & {v for v, _ in near})
    assert hits >= 0.9 * 10 * len(found)


def test_op4(run, texts):
    seen, expected = set(), {}
    for doc in sorted(texts):
        data = texts[doc].encode()
        cover = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                cover[at : at + 100] = True
            seen.add(window)
        spans = int(np.sum(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        expected[doc] = (len(data), int(cover.sum()), spans, sha256(np.frombuffer(data, np.uint8)[~cover].tobytes()).hexdigest())
    rows = run("op4_suffix_dedup")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == expected


def test_op6(run, texts):
    sets = {}
    for doc, text in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
        sets[doc] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    docs = sorted(sets)
    links = [(a, b) for k, a in enumerate(docs) for b in docs[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    reached = components(docs, links)
    rows = run("op6_ngram_jaccard")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {d: (len(sets[d]), reached[d]) for d in docs}


def plain_links(spark, folder):
    """(rows, number of links, links) by comparing all pairs of a label."""
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    good = {}
    for r in table:
        v = r["embedding"]
        if v is not None and None not in v and r["label"] is not None:
            v = np.array(v, float)
            if np.isfinite(v).all() and v.any():
                good[r["vec_id"]] = (r["label"], v / np.sqrt((v * v).sum()))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and good[a][1] @ good[b][1] >= 0.93]
    return table, len(links), links


def test_op7(spark, run, folder=SF):
    table, _, links = plain_links(spark, folder)
    reached = components([r["vec_id"] for r in table], links)
    count = {r["vec_id"]: 0 for r in table}
    for pair in links:
        for v in pair:
            count[v] += 1
    rows = run("op7_embedding_dedup", folder)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows} == {v: (count[v], reached[v], reached[v] == v) for v in count}


@pytest.fixture(scope="module")
def planted_vectors(spark, tmp_path_factory):
    """The given vectors, and clusters around some of them: chains, groups, copies, clusters that two labels share."""
    folder = tmp_path_factory.mktemp("vectors")
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rng = np.random.default_rng(9)
    rows, new = [tuple(r) for r in table.collect()], 10_000
    for i, (_, v, label) in enumerate(rows[:40]):
        at = np.array(v, float)
        for k in range(3 + i % 9):
            noise = rng.normal(size=len(at)) * np.linalg.norm(at) * (0.02 if i % 3 else 0.25) / np.sqrt(len(at))
            at = at + noise if i % 4 == 0 else np.array(v, float) + noise  # chains drift away from their start
            rows.append((new, at.tolist(), label if i % 5 else (label + k % 2) % 10))
            new += 1
    rows += [(new + k, v, label) for k, (_, v, label) in enumerate(rows[:15])]
    rows += [(new + 100, None, 1), (new + 101, [0.0] * len(rows[0][1]), 1), (new + 102, rows[0][1], None), (new + 103, [float("nan"), *rows[0][1][1:]], rows[0][2])]
    spark.createDataFrame(rows, table.schema).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_op7_on_planted_clusters(spark, run, planted_vectors):
    assert plain_links(spark, planted_vectors)[1] > 400
    test_op7(spark, run, planted_vectors)


def test_op3(run, texts):
    ranks = dict(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for doc, text in texts.items():
        of_byte = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text]) if text else np.empty(0, int)
        spans = token_counts.lines(text)
        counts, at = [0] * len(spans), 0
        for token in library.encode_ordinary(text):
            size = len(library.decode_single_token_bytes(token))
            chars = {int(c) for c in of_byte[at : at + size]}
            at += size
            shares = [sum(a <= c < b for c in chars) for a, b in spans]
            counts[int(np.argmax(shares))] += 1
        for k, ((a, b), n) in enumerate(zip(spans, counts, strict=True)):
            expected[doc, k] = (a, b, n)
    rows = run("op3_token_counts")
    got = {(r["doc_id"], r["section"]): (r["start"], r["stop"], r["n_tokens"]) for r in rows}
    assert set(got) == set(expected) and len(rows) == len(got)
    assert sum(got[k] != v for k, v in expected.items()) == 0


def test_op9(run, texts):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, total = {}, 0
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected[doc, piece] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = run("op9_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= 1.1 * -(-total // 4096) + 1


@pytest.mark.parametrize("name,folds,held,label,threshold,least", [("op5_toxicity", 5, 0, "toxic", 0.5, 0.9), ("op8_quality", 4, 2, "quality", 0.7, 0.9)])
def test_classifiers_on_held_out_labels(spark, run, name, folds, held, label, threshold, least):
    folder = "/root/testdata/sf0.01"
    docs = [r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = run(name, folder)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"]) % folds == held) for r in rows)
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(right) > 20 and np.mean(right) >= least


def test_op10_on_held_out_languages(spark, run):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = run("op10_language", folder)
    assert {r["doc_id"] for r in rows} == set(truth)
    learned = {lang for doc, (lang, _) in truth.items() if crc(doc) % 5}
    right = []
    for r in rows:
        lang, text = truth[r["doc_id"]]
        assert r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
            continue
        assert r["lang_pred"] in learned
        if r["held_out"] and lang is not None:
            right.append(r["lang_pred"] == lang)
    assert np.mean(right) >= 0.95
