"""Matching of ORFs to annotated coding sequences by their C-terminus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codonlake.alphabets import DEFAULT_C_TERMINAL
from codonlake.functions import c_terminal


def _tail(residues: str, n: int) -> Column:
    """The last ``n`` residues; null without residues, so that nothing equals it."""
    return F.when(F.length(residues) > 0, c_terminal(residues, n))


def _tails(cds: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Distinct tails of annotated proteins; those without a protein drop out in a generator, which no null check passes."""
    annotated = F.explode(F.filter(F.array(_tail("protein_sequence", n)), lambda t: t.isNotNull()))
    return cds.select(*keys[1:], annotated.alias("_tail")).select(*keys).distinct()


def matched_tails(orfs: DataFrame, cds: DataFrame, n: int = DEFAULT_C_TERMINAL) -> DataFrame:
    """``(seq_id, tails)``: for each sequence the tails of its ORFs that some CDS has.

    Only sequence ids and tails are shuffled. ``find_orfs`` takes the result and sets
    ``in_genbank`` while it searches, so that no ORF is moved for the match.
    """
    own = orfs.select(F.col("parent_id").alias("seq_id"), _tail("aa_sequence", n).alias("_tail")).distinct()
    return own.join(_tails(cds, ["_tail"], n), "_tail").groupBy("seq_id").agg(F.collect_list("_tail").alias("tails"))


def match_annotated(
    orfs: DataFrame, cds: DataFrame, n: int = DEFAULT_C_TERMINAL, same_parent: bool = False
) -> DataFrame:
    """Set ``in_genbank``: the last ``n`` residues equal those of some CDS.

    Annotated ends are first reduced to distinct tails, which the partial
    aggregation does before the shuffle. The join is a plain equality; Spark
    broadcasts the tails when their measured size allows it and otherwise
    splits hot tails on the ORF side at run time. As a tail occurs once on the
    right, no ORF is multiplied. ``same_parent`` restricts the match to CDS of
    the ORF's own sequence.
    """
    keys = ["_tail"] + (["parent_id"] if same_parent else [])
    tails = _tails(cds, keys, n).withColumn("_hit", F.lit(True))
    return (
        orfs.drop("in_genbank")
        .withColumn("_tail", _tail("aa_sequence", n))
        .join(tails, keys, "left")
        .withColumn("in_genbank", F.coalesce("_hit", F.lit(False)))
        .drop("_tail", "_hit")
    )
