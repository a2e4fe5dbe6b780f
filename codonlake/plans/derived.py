"""Biological tables derived from the given tables by fixed rules.

The given tables hold no genomes. Letters of a text are mapped to bases (and
to residues) by position in the alphabet, over whole tables and whole texts.
``oracle.py`` states the same rules in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codonlake.alphabets import AA_ALPHABET, DNA_ALPHABET, THREE_DI_ALPHABET
from codonlake.operators.matching import match_annotated
from codonlake.operators.proteins import derive_proteins
from codonlake.plans.jobs import orf_table
from codonlake.session import spread

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AS_BASES = (DNA_ALPHABET * 7)[:26]
# Letters B, J, O, U, X, Z stay as they are, so rare residues occur.
RESIDUES = AA_ALPHABET
# A many-to-one residue rule that stands in for a structural encoder.
STAND_IN_FROM = RESIDUES + "X"
STAND_IN_TO = "".join(THREE_DI_ALPHABET[(i * i) % 20] for i in range(21))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")


def _letters(text: str) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


_NO_LETTERS = bytes(b for b in range(256) if not bytes([b]).isalpha())
_BASES = bytes.maketrans((LETTERS + LETTERS.lower()).encode(), AS_BASES.encode() * 2)


def _as_bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters A to Z of texts, in either case, as bases; all other bytes are left out."""
    for batch in batches:
        texts = (value.as_buffer() if value.is_valid else None for value in batch.column(1))
        seqs = [None if t is None else t.to_pybytes().translate(_BASES, _NO_LETTERS) for t in texts]
        yield pa.record_batch([batch.column(0), pa.array(seqs, pa.binary()).cast(pa.string())], names=["seq_id", "seq"])


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seqs(seq_id, seq)``: one DNA sequence per document."""
    texts = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("seq_id"), "text")
    return texts.mapInArrow(_as_bases, "seq_id string, seq string")


def annotated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of documents whose label says good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("seq_id"))
    return sequences(spark, sf_dir).join(good, "seq_id", "left_semi")


def protein_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seqs(seq_id, seq)``: the letters of each conversation turn as residues."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id")
    return turns.select(
        F.concat_ws("_", F.lit("conv"), "conv_id", "turn").alias("seq_id"), _letters("text").alias("seq")
    )


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the texts; a sequence has no more letters than its text."""
    return table(spark, sf_dir, "documents").select(F.length("text"))


def orfs(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return orf_table(sequences(spark, sf_dir), lengths=lengths(spark, sf_dir), **options)


def coding_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cds``: ORFs of good documents without their first five residues."""
    found = orf_table(annotated_sequences(spark, sf_dir), bases=False, lengths=lengths(spark, sf_dir))
    # Residues remain if there are more than five codons.
    return found.where("end - start + 1 > 15").select(
        "parent_id",
        (F.col("start") - 1).alias("start"),
        "end",
        "strand",
        F.expr("substring(aa_sequence, 6)").alias("protein_sequence"),
    )


def matched_orfs(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return match_annotated(orfs(spark, sf_dir, bases=False), coding_sequences(spark, sf_dir), **options)


def proteins(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return derive_proteins(orfs(spark, sf_dir, **options))


def matched_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_proteins(matched_orfs(spark, sf_dir))


def stand_in_encoder():
    """Residue-by-residue rule; it exercises the encoder hook and is no structure."""
    rule = str.maketrans(STAND_IN_FROM, STAND_IN_TO)
    return lambda texts: [text.translate(rule) for text in texts]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORFs with label and a fixed score between 0 and 1 that grows with length."""
    n = F.col("aa_length").cast("double")
    return matched_proteins(spark, sf_dir).select(
        "parent_id",
        "orf_id",
        "aa_length",
        F.col("in_genbank").cast("int").alias("label"),
        (n / (n + 60.0)).alias("probability"),
        (n / (n + 60.0) > 0.5).cast("int").alias("predicted_label"),
    )
