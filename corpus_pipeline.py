"""The corpus pipeline: language ID, quality, n-gram near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept,
and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm import jaccard, langid, packing, quality, repeats
from starfold.llm.common import fold_of
from starfold.session import materialize, shared_folder, ship

#: A document is rejected if its main language has less than this share of it, or if it has no letter.
LEAST_SHARE = 0.5
#: A document is rejected if the probability of good quality is lower.
LEAST_QUALITY = 0.5

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a language of at least half of their text go. Learns from all folds but 0 of 5."""
    ship(spark)
    model = langid.fit(docs.filter(fold_of(F.col("doc_id"), 5) != 0))
    found = langid.identify(docs.select(*COLUMNS), model, out="_languages")
    share = langid.first_language(F.col("_languages"))[1]
    return found.filter((F.size("_languages") > 0) & (share >= LEAST_SHARE)).drop("_languages")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of poor quality go. Learns from all labels but those of fold 2 of 4."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_of(F.col("doc_id"), 4) != 2)
    model = quality.fit(docs, labels)
    return quality.score(docs.select(*COLUMNS), model, out="_score").filter(F.col("_score") >= LEAST_QUALITY).drop("_score")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays.

    A document is a row: rows that repeat an id with other texts are compared like any others, and of rows
    that repeat id and text one stays. A null id comes after all others.
    """
    ship(spark)
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    found = jaccard.join_components(rows, jaccard.Threshold(8, 10), width=5, key="_row").select("_row", "component_id").distinct()
    ids = rows.select("_row", "doc_id")
    first = found.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    stays = rows.join(first.select("first._row"), "_row", "left_semi")
    repeated = materialize(ids.groupBy("_row").count().filter("count > 1"))
    if repeated.limit(1).count():
        stays = stays.join(repeated, "_row", "left_anti").union(stays.join(repeated, "_row", "left_semi").dropDuplicates(["_row"]))
    return stays.select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters all of whose bytes are covered by 100-byte strings that occur earlier go; a document left without text goes.

    Rows that repeat an id with other texts are documents of their own; one with a null id stays whole.
    """
    ship(spark)
    cleaned = repeats.remove_repeats(docs, length=100, whole_characters=True, carry=["lang", "source"]).withColumn("text", F.col("kept").cast("string"))
    return cleaned.filter(F.length("text") > 0).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, with their sequence and place in it."""
    ship(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = packing.pieces(docs.select("doc_id", "text"), f.read(), with_ids=False, added=True)
    return packing.pack(pieces, max(1, docs.count() // packing.GROUP_ROWS), spread=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("ngram_jaccard_join", join_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: Models and suffix order aren't SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written to the shared checkpoint folder and read again by the next."""
    ship(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
