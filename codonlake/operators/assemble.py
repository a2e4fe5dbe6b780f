"""Joins of the stage tables to one table of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEYS = ["parent_id", "orf_id"]


def merge_stages(orfs: DataFrame, proteins: DataFrame, three_di: DataFrame) -> DataFrame:
    """ORFs with their protein and structural string; incomplete ones drop out."""
    return orfs.join(proteins.select(*KEYS, "protein_aa", "aa_length"), KEYS).join(
        three_di.select(*KEYS, "three_di", "method", "model_name", "inference_device"), KEYS
    )


def attach_entropy(features: DataFrame, entropies: DataFrame) -> DataFrame:
    """Entropies by ORF; 0 where there is none."""
    names = ["dna_entropy", "protein_entropy", "three_di_entropy"]
    joined = features.join(entropies.select(*KEYS, *names), KEYS, "left")
    return joined.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in names})


def completeness(orfs: DataFrame, features: DataFrame) -> DataFrame:
    """Expected and actual number of features of every sequence."""
    expected = orfs.groupBy("parent_id").agg(F.count("*").alias("expected"))
    actual = features.groupBy("parent_id").agg(F.count("*").alias("actual"))
    return expected.join(actual, "parent_id", "left").select(
        "parent_id", "expected", F.coalesce("actual", F.lit(0)).alias("actual")
    )
