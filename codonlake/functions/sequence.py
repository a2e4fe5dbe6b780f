"""String functions on nucleotide, protein and structural sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codonlake.alphabets import (
    DEFAULT_C_TERMINAL,
    DEFAULT_TABLE_ID,
    THREE_DI_ALPHABET,
    genetic_code,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Complement A, C, G, T in either case and reverse; other symbols stay."""
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def oriented(seq: Column | str, strand: Column | str) -> Column:
    """The sequence as read on ``strand``."""
    seq = _col(seq)
    return F.when(_col(strand) == "-", reverse_complement(seq)).otherwise(seq)


def subsequence(seq: Column | str, start: Column | str, end: Column | str, strand: Column | str) -> Column:
    """Nucleotides of a 1-based inclusive range counted on its own strand.

    An end beyond the sequence is clipped; a start below 1 or an end before
    the start fails the query.
    """
    seq, start, end = _col(seq), _col(start).cast("int"), _col(end).cast("int")
    checked = (
        F.when((start < 1) | (end < 1), F.raise_error(F.lit("coordinates must be >= 1")).cast("int"))
        .when(end < start, F.raise_error(F.lit("end coordinate precedes start coordinate")).cast("int"))
        .otherwise(start)
    )
    # On the reverse strand only the piece is complemented, not the parent.
    low = F.greatest(F.length(seq) - end + 1, F.lit(1))
    piece = seq.substr(low, F.length(seq) - checked + 2 - low)
    return F.when(_col(strand) == "-", reverse_complement(piece)).otherwise(seq.substr(checked, end - start + 1))


def translate_codons(nt: Column | str, table_id: int = DEFAULT_TABLE_ID) -> Column:
    """Residues of the complete codons of ``nt``; an ambiguous codon gives X.

    The code is one literal map, so the lookup is folded into the plan and
    needs no join.
    """
    pairs = ",".join(f"'{codon}','{aa}'" for codon, aa in genetic_code(table_id).items())
    code = F.expr(f"map({pairs})")
    codons = F.regexp_extract_all(F.upper(_col(nt)), F.lit("..."), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def strip_trailing_stop(aa: Column | str) -> Column:
    """Drop one trailing ``*``."""
    return F.regexp_replace(_col(aa), "[*]$", "")


def c_terminal(aa: Column | str, n: int = DEFAULT_C_TERMINAL) -> Column:
    """Last ``n`` residues after all trailing ``*`` are removed.

    A shorter sequence is returned whole, and so is any when ``n`` is 0.
    """
    if n < 0:
        raise ValueError("the C-terminal length must not be negative")
    clean = F.rtrim(_col(aa), F.lit("*"))
    return clean if n == 0 else F.right(clean, F.lit(n))


def has_start(aa: Column | str) -> Column:
    """True if a methionine occurs anywhere."""
    return F.contains(_col(aa), F.lit("M"))


def has_stop(aa: Column | str) -> Column:
    """True if a stop occurs anywhere."""
    return F.contains(_col(aa), F.lit("*"))


def strand_of_frame(signed_frame: Column | str) -> Column:
    return F.when(_col(signed_frame) < 0, "-").otherwise("+")


def abs_frame(signed_frame: Column | str) -> Column:
    return F.abs(_col(signed_frame))


def replace_rare_residues(aa: Column | str) -> Column:
    """Residues U, Z, O, B become X, as structural encoders do not know them."""
    return F.translate(_col(aa), "UZOB", "XXXX")


def encoder_prompt(aa: Column | str) -> Column:
    """Encoder input text: the direction tag, then spaced upper-case residues."""
    spaced = F.regexp_replace(replace_rare_residues(aa), "(.)(?=.)", "$1 ")
    return F.concat(F.lit("<AA2fold> "), F.upper(spaced))


def trim_to_length(three_di: Column | str, length: Column | str) -> Column:
    return _col(three_di).substr(F.lit(1), _col(length).cast("int"))


def classes_to_three_di(class_ids: Column | str, length: Column | str) -> Column:
    """Letters of the first ``length`` class ids (0 to 19)."""
    letters = F.lit(THREE_DI_ALPHABET)
    ids = F.slice(_col(class_ids), F.lit(1), _col(length).cast("int"))
    return F.array_join(F.transform(ids, lambda i: letters.substr(i.cast("int") + 1, F.lit(1))), "")
