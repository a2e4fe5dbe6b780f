"""ORFs that a finder has already written as FASTA with coordinates in the header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.alphabets import DEFAULT_TABLE_ID
from codonlake.functions import abs_frame, has_start, has_stop, strand_of_frame
from codonlake.operators.orfs import attach_orf_sequences
from codonlake.sources.fasta import _paths

# The two header forms, ``parent-orfN [parent frame F S E]`` and
# ``orfN [parent frame F S E]``.
HEADER = r"^(?:(\S+)-)?(orf\d+)\s+\[(\S+)\s+frame\s+([+-]?\d+)\s+(\d+)\s+(\d+)\]\s*$"


def read_orf_fasta(
    spark: SparkSession, path, seqs: DataFrame, table_id: int = DEFAULT_TABLE_ID
) -> tuple[DataFrame, DataFrame]:
    """``(orfs, rejected)`` from an ORF FASTA and its parent sequences.

    Rejected rows have a header of neither form, name two different parents
    or name a parent that is not in ``seqs``; ``problem`` says which.
    """
    text = spark.read.option("lineSep", "\n>").text(_paths(path))
    record = F.regexp_replace("value", r"^\s*>", "")
    rows = text.where(F.col("value").rlike(r"\S")).select(
        F.regexp_replace(F.regexp_extract(record, r"^([^\n]*)", 1), "\r", "").alias("header"),
        F.regexp_replace(F.regexp_extract(record, r"^[^\n]*\n([\s\S]*)$", 1), r"\s+", "").alias("aa_sequence"),
    )

    def group(i: int):
        return F.regexp_extract("header", HEADER, i)

    parsed = rows.select(
        "header", "aa_sequence", *[group(i).alias(f"g{i}") for i in range(1, 7)]
    ).withColumn(
        "problem",
        F.when(F.col("g2") == "", "header form")
        .when((F.col("g1") != "") & (F.col("g1") != F.col("g3")), "two parents")
    )
    frame = F.col("g4").cast("int")
    good = parsed.where(F.col("problem").isNull()).select(
        "header",
        F.col("g3").alias("parent_id"),
        F.col("g2").alias("orf_id"),
        F.col("g5").cast("int").alias("start"),
        F.col("g6").cast("int").alias("end"),
        strand_of_frame(frame).alias("strand"),
        abs_frame(frame).alias("frame"),
        "aa_sequence",
        F.lit(table_id).alias("table_id"),
        has_start("aa_sequence").alias("has_start_codon"),
        has_stop("aa_sequence").alias("has_stop_codon"),
        F.lit(False).alias("in_genbank"),
    )
    found, orphans = attach_orf_sequences(good, seqs)
    rejected = (
        parsed.where(F.col("problem").isNotNull())
        .select("header", "problem")
        .unionByName(orphans.select("header", F.lit("unknown parent").alias("problem")))
    )
    return found.drop("header"), rejected
