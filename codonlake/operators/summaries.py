"""Reports over sequences, ORFs and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codonlake.operators.quantiles import exact_quantiles


def run_totals(seqs: DataFrame, orfs: DataFrame) -> DataFrame:
    """One row: sequences, ORFs, proteins and matched ORFs."""
    n_seqs = seqs.agg(F.count("*").alias("n_sequences"))
    counts = orfs.agg(
        F.count("*").alias("n_orfs"),
        F.count("protein_aa").alias("n_proteins"),
        F.count_if("in_genbank").alias("n_matched"),
    )
    # Both sides are one-row aggregates.
    one = F.lit(1).alias("_one")
    return n_seqs.select("*", one).join(counts.select("*", one), "_one").drop("_one")


def by_sequence(features: DataFrame) -> DataFrame:
    """ORF count, mean protein length and mean entropies of every sequence."""
    return features.groupBy("parent_id").agg(
        F.count("*").alias("n_orfs"),
        F.avg("aa_length").alias("mean_protein_length"),
        F.avg("dna_entropy").alias("mean_dna_entropy"),
        F.avg("protein_entropy").alias("mean_protein_entropy"),
    )


def level_comparison(features: DataFrame) -> DataFrame:
    """Entropies of each ORF side by side with its annotation."""
    return features.select("parent_id", "orf_id", "in_genbank", "dna_entropy", "protein_entropy", "three_di_entropy")


def comparison_report(features: DataFrame, level: str = "three_di_entropy") -> DataFrame:
    """Protein entropy against another level, by annotation, with exact quartiles."""
    quartiles = exact_quantiles(features, "in_genbank", "protein_entropy", [0.25, 0.5, 0.75])
    quartiles = quartiles.withColumnRenamed("in_genbank", "_group")
    moments = features.groupBy("in_genbank").agg(
        F.count("*").alias("n"),
        F.avg("protein_entropy").alias("mean_protein_entropy"),
        F.avg(level).alias("mean_other_entropy"),
        F.stddev_samp("protein_entropy").alias("sd_protein_entropy"),
        F.corr("protein_entropy", level).alias("correlation"),
    )
    return (
        moments.join(quartiles, F.col("in_genbank").eqNullSafe(F.col("_group")), "left")
        .select(
            *moments.columns,
            F.col("q")[0].alias("q1_protein_entropy"),
            F.col("q")[1].alias("median_protein_entropy"),
            F.col("q")[2].alias("q3_protein_entropy"),
        )
    )


def label_distribution(features: DataFrame, label: str = "label") -> DataFrame:
    return features.groupBy(label).agg(F.count("*").alias("n"))


def class_imbalance(features: DataFrame, label: str = "label") -> DataFrame:
    """Share of positives, and whether it lies outside 10 % to 90 %."""
    share = F.avg(label)
    return features.agg(
        share.alias("positive_ratio"), ((share < 0.1) | (share > 0.9)).alias("imbalanced")
    )
