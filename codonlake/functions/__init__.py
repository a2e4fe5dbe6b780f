"""Column functions: every one is a built-in expression, none calls Python."""

from codonlake.functions.entropy import max_entropy, sequence_entropy, shannon_entropy
from codonlake.functions.sequence import (
    abs_frame,
    c_terminal,
    classes_to_three_di,
    encoder_prompt,
    has_start,
    has_stop,
    oriented,
    replace_rare_residues,
    reverse_complement,
    strand_of_frame,
    strip_trailing_stop,
    subsequence,
    translate_codons,
    trim_to_length,
)

__all__ = [
    "abs_frame",
    "c_terminal",
    "classes_to_three_di",
    "encoder_prompt",
    "has_start",
    "has_stop",
    "max_entropy",
    "oriented",
    "replace_rare_residues",
    "reverse_complement",
    "sequence_entropy",
    "shannon_entropy",
    "strand_of_frame",
    "strip_trailing_stop",
    "subsequence",
    "translate_codons",
    "trim_to_length",
]
