"""The corpus pipeline: raw documents in, token ids of a clean mix out.

Each stage reads the table its predecessor wrote and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.llm import mixing, pieces, quality, secrets, simhash
from codonlake.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked and ``n_chars`` as it is then."""
    clean = secrets.masked(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    vocabulary = pieces.Vocabulary.load()
    read = docs.select("doc_id", "lang", "source", "text")  # other columns may bear the names added here
    rows = pieces.with_text(pieces.encoded(read, model=vocabulary), model=vocabulary)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mix),
    ("sentencepiece", tokens),
]

#: Fingerprints, draws and token ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
