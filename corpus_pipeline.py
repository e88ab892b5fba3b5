"""Documents to token ids in stages; each stage's rows are written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscope.llm import decontaminate, line_dedup, pieces, quality_rules, simhash
from tabscope.plans.stored import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def without_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, lines found on many sites removed but for their first place; ``n_chars`` follows the text."""
    kept = line_dedup.remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return kept.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest id."""
    return simhash.one_of_each(docs)


def without_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents by merge-dropout, and the texts these decode to."""
    encoded = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), decoded="text")
    return encoded.withColumn("n_pieces", F.size("ids").cast("bigint"))


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", without_boilerplate_lines),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark_documents),
    ("SentencePiece encoding and decoding", as_pieces),
]

#: Jensen-Shannon distances, fingerprints' components and merge-dropout are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
