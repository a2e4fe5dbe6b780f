"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that filters further up must not compute again.

    A filter on a projected column is pushed below the projection together
    with a copy of its expression. It cannot pass a generator, so the columns
    come out of a one-row ``inline``.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
