"""Translation of ORFs to proteins, and the checks around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codonlake.alphabets import DEFAULT_TABLE_ID
from codonlake.functions import strip_trailing_stop, translate_codons
from codonlake.operators.binding import compute_once


def translation_mismatches(orfs: DataFrame, table_id: int = DEFAULT_TABLE_ID) -> DataFrame:
    """ORFs whose supplied residues differ from their translation."""
    return compute_once(orfs, translated=translate_codons("nt_sequence", table_id)).where(
        ~F.col("translated").eqNullSafe(F.col("aa_sequence"))
    )


def translate_orfs(orfs: DataFrame, table_id: int = DEFAULT_TABLE_ID, on_mismatch: str = "fail") -> DataFrame:
    """Proteins of annotated ORFs: adds ``protein_aa`` and ``aa_length``.

    The supplied ``aa_sequence`` must equal the translation. ``fail`` stops
    the query at the first difference; ``reject`` leaves such ORFs out, and
    :func:`translation_mismatches` lists them.
    """
    if on_mismatch not in ("fail", "reject"):
        raise ValueError("on_mismatch must be 'fail' or 'reject'")
    translated = compute_once(orfs, _translated=translate_codons("nt_sequence", table_id))
    same = F.col("_translated").eqNullSafe(F.col("aa_sequence"))
    if on_mismatch == "reject":
        translated = translated.where(same)
        residues = F.col("_translated")
    else:
        message = F.concat(F.lit("translation mismatch for ORF "), F.col("parent_id"), F.lit("/"), F.col("orf_id"))
        residues = F.when(same, F.col("_translated")).otherwise(F.raise_error(message))
    return (
        translated.withColumn("protein_aa", strip_trailing_stop(residues))
        .withColumn("aa_length", F.length("protein_aa"))
        .drop("_translated")
    )


def derive_proteins(orfs: DataFrame) -> DataFrame:
    """Proteins of ORFs annotated in the same plan.

    ``aa_sequence`` was translated just before, so translating once more to
    compare would only double the work.
    """
    return orfs.withColumn("protein_aa", strip_trailing_stop("aa_sequence")).withColumn(
        "aa_length", F.length("protein_aa")
    )
