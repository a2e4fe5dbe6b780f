"""Entropy of every representation level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codonlake.alphabets import ALPHABET_SIZES
from codonlake.functions import sequence_entropy
from codonlake.functions.entropy import short_entropy
from codonlake.operators.chunks import chunked

CHUNK_SYMBOLS = 100_000


def add_entropy(df: DataFrame, seq: str, name: str = "entropy", alphabet_size=None, normalize=False) -> DataFrame:
    return df.withColumn(name, sequence_entropy(seq, alphabet_size, normalize))


def global_entropy(seqs: DataFrame, normalize: bool = False) -> DataFrame:
    """DNA entropy and length of every input sequence."""
    return seqs.select(
        "seq_id",
        F.length("seq").alias("dna_length"),
        short_entropy("seq", ALPHABET_SIZES["dna"], normalize).alias("dna_entropy_global"),
    )


def level_entropies(features: DataFrame, normalize: bool = False) -> DataFrame:
    """Add nucleotide, protein and structural entropy of every ORF."""
    levels = {
        "dna_entropy": ("nt_sequence", "dna"),
        "protein_entropy": ("protein_aa", "protein"),
        "three_di_entropy": ("three_di", "three_di"),
    }
    entropies = {name: short_entropy(seq, ALPHABET_SIZES[level], normalize) for name, (seq, level) in levels.items()}
    return features.drop(*levels).withColumns(entropies)


def alphabet_sizes() -> Column:
    """The map of alphabet sizes stored with each result."""
    return F.create_map(*[F.lit(x) for pair in ALPHABET_SIZES.items() for x in pair])


def empty_alphabet_sizes() -> Column:
    return F.expr("cast(map() as map<string,int>)")


def symbol_counts(seqs: DataFrame, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """Count of every symbol per sequence: ``(key, symbol, n)``.

    Sequences are cut into chunks and counted there, so only a few rows per
    chunk are shuffled and a very long sequence is counted piece by piece.
    """
    chunks = chunked(seqs, CHUNK_SYMBOLS, key=key, seq=seq).select(key, F.upper("bases").alias("_text"))
    counts = F.transform(
        F.array_distinct(F.split("_text", "")),
        lambda c: F.struct(
            c.alias("symbol"), (F.length("_text") - F.length(F.replace(F.col("_text"), c, F.lit("")))).alias("n")
        ),
    )
    counted = chunks.where(F.length("_text") > 0).select(key, F.inline(counts))
    return counted.groupBy(key, "symbol").agg(F.sum("n").alias("n"))


def entropy_from_counts(counts: DataFrame, key: str = "seq_id") -> DataFrame:
    """Entropy from symbol counts, with H = log2 N - (sum n log2 n) / N."""
    total = F.sum("n")
    return counts.groupBy(key).agg(
        total.alias("n_symbols"),
        F.greatest(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, F.lit(0.0)).alias("entropy"),
    )
