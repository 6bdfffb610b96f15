"""The pipeline's stages on the smallest tables, each against what its operator says."""

import random

import corpus_pipeline as cp
import pytest

import __spark_entry__ as entry
from starfold.llm.queries import queries as llm_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_only_drop(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert [n for n, _ in cp.STAGES] == [n for n, _, _ in stages] and len(cp.STAGES) == 5


def test_near_duplicates_go_once(spark, stages):
    _, before, after = stages[2]
    texts = [r["text"] for r in before.collect()]
    assert after.count() <= len(set(texts))


def test_last_stage_packs_all_tokens(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert all(r["offset"] + r["length"] <= 4096 for r in rows)


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert set(llm_queries()) <= set(names) and "pipeline" in names


def test_pipeline_runs_on_rows_with_nulls(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", None, None), (10**6 + 1, "", None, "s", 0), (None, "a b c d e f g", "en", "s", 13)], docs.schema)
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.filter("doc_id >= 1000000").count() == 0 and out.count() > 50


def test_near_duplicates_and_passages_go_by_row(spark):
    """Repeated ids, repeated rows and null ids, in the two stages that compare documents."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d = (words(80) for _ in range(4))
    near = a + " end"
    rows = [(1, a), (5, near), (5, b), (5, b), (7, c), (None, d), (None, d), (None, near), (8, None), (9, b)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    after = cp.join_near_duplicates(spark, docs, SF)
    assert after.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in after.collect()], key=key) == sorted([(1, a), (5, b), (7, c), (None, d), (8, None)], key=key)
    mixed = spark.createDataFrame([(1, a, "en", "x", 0), (2, a, "en", "y", 0), (2, b, "de", None, 0), (None, a, "en", "z", 0), (3, "é" + a[:120], "en", "w", 0)], docs.schema)
    kept = {(r["doc_id"], r["source"]): (r["text"], r["n_chars"]) for r in cp.remove_repeated_passages(spark, mixed, SF).collect()}
    assert kept == {(1, "x"): (a, len(a)), (2, None): (b, len(b)), (None, "z"): (a, len(a)), (3, "w"): ("é", 1)}


def test_packing_takes_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "s", 0), (1, "three", "en", "s", 0), (None, "four", None, None, None), (1, "one two", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.pack_sequences(spark, docs, SF).collect()
    assert len(out) == 4 and len({r["sequence_id"] for r in out}) == 1
    end = 0
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == end
        end += r["length"]
