"""Token-budget batches over a whole table.

Rows are taken from the longest to the shortest; a batch is closed when one
more row would make (rows x longest row) exceed the budget, and a row longer
than the budget stands alone. Where a batch is cut depends only on how many
rows there are of each length, so the cuts are made on that histogram and no
task ever sees the rows in sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from codonlake.session import stored

_INDEX_BITS = 33


def _cut(budget: int):
    """Walk the histogram from long to short and note where batches fall.

    Every length gets the number of longer rows, the batch still open with its
    free places, the number of the next batch and the rows that a batch of this length holds.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, free, longer = 0, 0, 0
        for part in parts:
            out = []
            for length, rows in zip(part["length"].tolist(), part["rows"].tolist()):
                size = max(1, budget // length) if length else rows + free + 1
                joining = min(free, rows)
                opened = -(-(rows - joining) // size)
                out.append((length, longer, batch, joining, batch + 1, size))
                longer += rows
                if opened:
                    batch += opened
                    free = opened * size - (rows - joining)
                else:
                    free -= joining
            yield pd.DataFrame(out, columns=["length", "longer", "open", "joining", "next", "size"])

    return cut


def _in_order(df: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Rows with ``place``, their 0-based place by descending length and keys.

    Range partitions are sorted and stored with each row's index in its partition; the sizes of
    the partitions before it complete the place. A length shared by very many
    rows spreads over partitions like any other.
    """
    order = [F.desc("length"), *[F.asc(k) for k in keys]]
    index = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_index", index)
    rows = stored(rows, "rows-in-order").withColumn("_part", F.shiftright("_index", _INDEX_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_index").bitwiseAND((1 << _INDEX_BITS) - 1)
    return rows.join(offsets, "_part").select(*keys, "length", *carried, place.alias("place"))


def token_budget_batches(df: DataFrame, length: str, budget: int, keys: list[str], carried: list[str] | None = None) -> DataFrame:
    """``(keys, length, batch_id)`` with batches numbered from 1, longest first, and the ``carried`` columns before the last.

    ``keys`` must identify a row; rows of one length follow each other by key. The
    histogram holds one row per distinct length, and n distinct lengths take at
    least n^2 / 2 residues, so the one task that cuts it stays small.
    """
    if budget <= 0:
        raise ValueError("token budget must be > 0")
    carried = carried or []
    rows = _in_order(df.select(*keys, F.col(length).cast("long").alias("length"), *carried), keys, carried)
    cuts = (
        rows.groupBy("length")
        .agg(F.count("*").alias("rows"))
        .repartition(1)
        .sortWithinPartitions(F.desc("length"))
        .mapInPandas(_cut(budget), "length long, longer long, open long, joining long, next long, size long")
    )
    rank = F.col("place") - F.col("longer")
    batch = F.when(rank < F.col("joining"), F.col("open")).otherwise(
        F.col("next") + F.floor((rank - F.col("joining")) / F.col("size"))
    )
    return rows.join(cuts, "length").select(*keys, "length", *carried, batch.cast("long").alias("batch_id"))


def batch_report(batches: DataFrame) -> DataFrame:
    """Rows, longest row and total length of every batch."""
    return batches.groupBy("batch_id").agg(
        F.count("*").alias("n_sequences"),
        F.max("length").alias("max_length"),
        F.sum("length").alias("total_length"),
    )


def estimated_batches(df: DataFrame, length: str, budget: int) -> DataFrame:
    """The estimate shown before a run: total length over budget, rounded up."""
    return df.agg(
        F.count("*").alias("n_sequences"), F.ceil(F.sum(length) / budget).cast("long").alias("estimated_batches")
    )
