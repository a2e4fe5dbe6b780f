"""Labels and rules on rows that need no other row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Model names and the method stored with their output.
BASE_MODEL = "gbouras13/modernprost-base"
PROFILES_MODEL = "gbouras13/modernprost-profiles"
METHOD_BASE = "modernprost_base"
METHOD_PROFILES = "modernprost_profiles"
METHOD_OTHER = "prostt5_aa2fold"

LOW_COMPLEXITY_BITS = 2.0


def encoding_method(model_name: Column) -> Column:
    return (
        F.when(model_name == PROFILES_MODEL, METHOD_PROFILES)
        .when(model_name == BASE_MODEL, METHOD_BASE)
        .otherwise(METHOD_OTHER)
    )


def is_low_complexity(entropy: Column) -> Column:
    return entropy < LOW_COMPLEXITY_BITS


def confidence_band(probability: Column) -> Column:
    """Band of the more likely class: high above 0.9, medium from 0.6, else low."""
    best = F.greatest(probability, 1 - probability)
    return F.when(best > 0.9, "high").when(best >= 0.6, "medium").otherwise("low")


def predicted_label(probability: Column, threshold: float = 0.5) -> Column:
    """1 if the probability lies strictly above the threshold."""
    return (probability > threshold).cast("int")


def filter_features(features: DataFrame, strand=None, has_stop_codon=None, in_genbank=None) -> DataFrame:
    """Features by strand, stop codon and annotation; ``None`` does not filter."""
    wanted = {"strand": strand, "has_stop_codon": has_stop_codon, "in_genbank": in_genbank}
    for name, value in wanted.items():
        if value is not None:
            features = features.where(F.col(name) == value)
    return features


def sequence_lengths(df: DataFrame, seq: str = "aa_sequence") -> DataFrame:
    return df.select(F.length(seq).alias("length"))


def first_rows(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)
