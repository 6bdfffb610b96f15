"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm import bpe, collocations, embedding_dedup, hard_negatives, jaccard, langid, nearest, packing, quality, repeats, sharding, token_counts, toxicity
from starfold.llm.common import fold_of


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held(out: Column) -> Column:
    """``held_out``; a row with a null id is in no fold, so it isn't held out (nor learned from)."""
    return F.coalesce(out, F.lit(False)).alias("held_out")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and give digests of both."""
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, vocabulary).drop("text").select(
        "doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    )
    return bpe.decode(encoded, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector, among all."""
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token across two lines counts for the one with most of it."""
    ranks = dict(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.count_tokens(docs, ranks, public_tokenizers.PATTERN)
    return found.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove bytes of documents covered by 100-byte strings that occur earlier."""
    found = repeats.remove_repeats(_read(spark, sf_dir, "documents"), length=100)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity; labels of fold 0 of 5 are never learned."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", _held(held_out), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of at least 0.85."""
    return jaccard.join_components(_read(spark, sf_dir, "documents"), jaccard.Threshold(85, 100), width=4)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of at least 0.93."""
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.93)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for quality; labels of fold 2 of 4 are never learned."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, _read(spark, sf_dir, "labels").filter(~held_out))
    scored = quality.score(docs, model).drop("text")
    return scored.select("doc_id", _held(held_out), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most 4096."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = packing.pieces(docs, f.read(), with_ids=False, added=True)
    groups = max(1, docs.count() // packing.GROUP_ROWS)
    return packing.pack(pieces, groups, spread=("doc_id", "piece", "ids_crc32"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the main language of every document; fold 0 of 5 is never learned."""
    docs = _read(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _held(held_out), *langid.first_language(F.col("languages")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector's five best of its label, five of other labels that score nearly as much; some labels are moved first."""
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language, of 2 to 4 words that occur 30 times."""
    return collocations.collocations(_read(spark, sf_dir, "documents"), least=30, longest=4, top=2000)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal all documents into 40 shards of equal counts, each with its share of every source."""
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    found = sharding.interleave(rows, 40, stratum="source", key=["doc_id", "size", "text_crc32"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_bpe_roundtrip, op2_nearest, op3_token_counts, op4_suffix_dedup, op5_toxicity, op6_ngram_jaccard, op7_embedding_dedup, op8_quality, op9_packing, op10_language, op11_hard_negatives, op12_collocations, op13_sharding]
    return {f.__name__: f for f in found}
