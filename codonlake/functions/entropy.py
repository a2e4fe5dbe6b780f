"""Shannon entropy as a column expression."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from codonlake.functions.sequence import _col

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz*"


def _symbols(seq: Column) -> Column:
    """Distinct symbols of a string.

    A chromosome split into one-letter strings would not fit in memory, so
    letters are taken as given and only other symbols are split off.
    """
    others = F.regexp_replace(seq, "[A-Za-z*]+", "")
    fixed = F.array(*[F.lit(c) for c in _LETTERS])
    held = F.filter(fixed, lambda c: F.contains(seq, c))
    return F.when(others == "", held).otherwise(F.concat(held, F.array_distinct(F.split(others, ""))))


def shannon_entropy(seq: Column | str, alphabet_size: int | None = None, normalize: bool = False) -> Column:
    """Entropy in bits over the symbols present; an empty string gives 0.

    With ``normalize`` and an alphabet of more than one symbol the result is
    divided by the logarithm of the alphabet size.
    """

    def entropy_of(bound: Column) -> Column:
        text, total = bound["text"], bound["total"]
        shares = F.transform(
            _symbols(text), lambda c: (total - F.length(F.replace(text, c, F.lit("")))) / total
        )
        return F.aggregate(shares, F.lit(0.0), lambda h, p: F.when(p > 0, h - p * F.log2(p)).otherwise(h))

    # The one-element array binds the text and its length, which the lambdas
    # would otherwise compute anew for every symbol.
    text = _col(seq)
    bound = F.array(F.struct(text.alias("text"), F.length(text).alias("total")))
    bits = F.get(F.transform(bound, entropy_of), F.lit(0))
    entropy = F.when(F.length(text) == 0, F.lit(0.0)).otherwise(bits)
    if normalize and alphabet_size and alphabet_size > 1:
        entropy = entropy / F.lit(max_entropy(alphabet_size))
    return entropy


def sequence_entropy(seq: Column | str, alphabet_size: int | None = None, normalize: bool = False) -> Column:
    """Entropy of the upper-cased sequence."""
    return shannon_entropy(F.upper(_col(seq)), alphabet_size, normalize)


def max_entropy(alphabet_size: int) -> float:
    return math.log2(alphabet_size)


def entropies_of(texts: list[str | None]) -> np.ndarray:
    """Entropy in bits of each text, counted for all of them at once; not a number for null."""
    held = [text if text is not None and text.isascii() else "" for text in texts]
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    letters = np.frombuffer("".join(held).encode("ascii"), np.uint8)
    counts = np.bincount(np.repeat(np.arange(len(held)) * 128, lengths) + letters, minlength=128 * len(held))
    used = np.flatnonzero(counts)
    share = counts[used] / lengths[used // 128]
    bits = 0.0 - np.bincount(used // 128, share * np.log2(share), minlength=len(held))
    for k, text in enumerate(texts):
        if text is None:
            bits[k] = np.nan
        elif not text.isascii():
            share = np.unique(list(text), return_counts=True)[1] / len(text)
            bits[k] = 0.0 - (share * np.log2(share)).sum()
    return bits


#: Symbols that are counted at once.
_AT_ONCE = 1 << 21


def _entropies(texts: pa.Array) -> pa.Array:
    """Entropy in bits of each text of an Arrow array, null for null; ASCII is counted on the bytes, some megabytes at a time."""
    texts = texts.cast(pa.large_string())
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    places = np.frombuffer(texts.buffers()[1] or bytes(8), np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) and data[places[0] : places[-1]].max(initial=0) >= 128:
        bits = entropies_of(texts.to_pylist())
    else:
        bits, row = np.zeros(len(texts)), 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(places, places[row] + _AT_ONCE, "right")) - 1)
            lengths = np.diff(places[row : last + 1])
            counts = np.zeros(128 * len(lengths), np.int64)
            if last == row + 1:
                for at in range(places[row], places[last], _AT_ONCE):
                    counts += np.bincount(data[at : min(at + _AT_ONCE, places[last])], minlength=128)
            else:
                cells = np.repeat(np.arange(len(lengths)) * 128, lengths) + data[places[row] : places[last]]
                counts += np.bincount(cells, minlength=len(counts))
            used = np.flatnonzero(counts)
            share = counts[used] / lengths[used // 128]
            bits[row:last] = 0.0 - np.bincount(used // 128, share * np.log2(share), minlength=len(lengths))
            row = last
    return pa.array(bits, mask=texts.is_null().to_numpy(zero_copy_only=False))


def short_entropy(seq: Column | str, alphabet_size: int | None = None, normalize: bool = False) -> Column:
    """``sequence_entropy`` of sequences of which a batch fits a task, such as those of ORFs, counted batch by batch."""

    @F.arrow_udf("double")
    def bits(texts: pa.Array) -> pa.Array:
        return _entropies(texts)

    entropy = bits(F.upper(_col(seq)))
    return entropy / F.lit(max_entropy(alphabet_size)) if normalize and alphabet_size and alphabet_size > 1 else entropy
