"""Alphabets and genetic codes.

The genetic codes follow the public NCBI list: the standard code written in
TCAG order, and for every other table the codons in which it differs.
"""

from __future__ import annotations

from itertools import product

# Alphabets of the three representation levels.
DNA_ALPHABET = "ACGT"
DNA_ALPHABET_WITH_N = "ACGTN"
AA_ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
AA_ALPHABET_EXTENDED = "ACDEFGHIKLMNPQRSTVWYX*"
THREE_DI_ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

# Defaults shared by the jobs.
DEFAULT_TABLE_ID = 11
DEFAULT_MIN_NT_LENGTH = 90
DEFAULT_MIN_AA_LENGTH = 30
DEFAULT_ENCODING_SIZE = 10_000
DEFAULT_C_TERMINAL = 10
SCHEMA_VERSION = "2.0.0"

# Symbols counted per level, and the sizes stored in results.
ALPHABET_SIZES = {"dna": 4, "protein": 20, "three_di": 20}

# The standard genetic code, codons in TCAG order.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Differences of each NCBI table from the standard code.
CODE_DIFFERENCES: dict[int, dict[str, str]] = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    11: {},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    15: {"TAG": "Q"},
    16: {"TAG": "L"},
    21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"},
    22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
    27: {"TAG": "Q", "TAA": "Q", "TGA": "W"},
    28: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    29: {"TAA": "Y", "TAG": "Y"},
    30: {"TAA": "E", "TAG": "E"},
    31: {"TGA": "W", "TAG": "E", "TAA": "E"},
    32: {"TAG": "W"},
    33: {"TAA": "Y", "TGA": "W", "AGA": "S", "AGG": "K"},
}


def genetic_code(table_id: int = DEFAULT_TABLE_ID) -> dict[str, str]:
    """Codon -> residue for one NCBI table."""
    if table_id not in CODE_DIFFERENCES:
        raise ValueError(f"unknown genetic code table: {table_id}")
    codons = ("".join(bases) for bases in product("TCAG", repeat=3))
    return dict(zip(codons, STANDARD_CODE)) | CODE_DIFFERENCES[table_id]


def stop_codons(table_id: int = DEFAULT_TABLE_ID) -> list[str]:
    return [codon for codon, residue in genetic_code(table_id).items() if residue == "*"]


def genetic_code_table(spark):
    """Dimension table ``(table_id, codon, aa)`` over all known codes."""
    rows = [(t, codon, aa) for t in CODE_DIFFERENCES for codon, aa in genetic_code(t).items()]
    return spark.createDataFrame(rows, "table_id int, codon string, aa string")


def alphabet_table(spark):
    """Dimension table ``(level, symbol)``."""
    levels = {"dna": DNA_ALPHABET, "protein": AA_ALPHABET, "three_di": THREE_DI_ALPHABET}
    return spark.createDataFrame(
        [(level, symbol) for level, symbols in levels.items() for symbol in symbols],
        "level string, symbol string",
    )
