"""Row validation: a reason column, and the split into valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def orf_problem() -> Column:
    """Why an ORF row is invalid, or null."""
    return (
        F.when(~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)), "invalid strand")
        .when(~F.coalesce(F.col("frame").isin(0, 1, 2, 3), F.lit(False)), "invalid frame")
        .when(F.coalesce(F.col("start") < 0, F.lit(True)), "invalid start")
        .when(F.coalesce(F.col("end") <= F.col("start"), F.lit(True)), "invalid end")
    )


def protein_problem(aa: str = "protein_aa", length: str = "aa_length") -> Column:
    """Why a protein row is invalid, or null."""
    same = F.col(length) == F.length(F.col(aa))
    return F.when(~F.coalesce(same, F.lit(False)), "aa_length does not match the sequence")


def split_valid(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; rejected rows carry ``problem``."""
    checked = df.withColumn("problem", problem)
    return checked.where(F.col("problem").isNull()).drop("problem"), checked.where(F.col("problem").isNotNull())
