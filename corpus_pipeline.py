"""A training corpus in five stages: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import exact_dedup, packing, quality, simhash, substring
from sparkfolio.llm.common import labels, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies in this stage: five-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, labels(spark, sf_dir)).select(COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_similar(docs, shingle=SHINGLE, similarity=SIMILARITY).select(COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words are their kept words joined by one space; others stay as they are. A document of
    which nothing is left goes."""
    x = substring.remove_repeats(docs, carry=("lang", "source", "n_chars")).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    return x.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    x = packing.pack(packing.pieces(docs, "byte_bpe_50k.json", 2048), 2048)
    return x.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("best-fit packing", packed),
]

#: The model, the fingerprints' components and the packing are no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
