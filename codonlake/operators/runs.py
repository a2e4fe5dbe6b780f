"""Runs between stops of many short sequences at once.

The texts of a batch are laid behind one another, each from a multiple of three on, so a
frame of all of them is every third codon of one array. Stops and the last codons of the
texts end runs; nothing is walked base by base.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from codonlake.alphabets import genetic_code, stop_codons

AT_ONCE = 1 << 21
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
_PAD = ("NNN", "NNNNN", "NNNN")


@cache
def _codes(table_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each symbol (4: none of the bases), and residue and stop flag of each codon of such numbers."""
    number = np.full(256, 4, np.uint8)
    number[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    at = lambda codon: sum(int(number[ord(c)]) * 5 ** (2 - k) for k, c in enumerate(codon))
    residue, stop = np.full(125, ord("X"), np.uint8), np.zeros(125, bool)
    for codon, aa in genetic_code(table_id).items():
        residue[at(codon)] = ord(aa)
    stop[[at(codon) for codon in stop_codons(table_id)]] = True
    return number, residue, stop


def _symbols(text: str) -> np.ndarray:
    """One number for each code point; those beyond a byte are alike."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 255).astype(np.uint8)


def runs_of(texts: list[str], table_id: int, least: int, residues: bool, bases: bool = True) -> tuple[np.ndarray, ...]:
    """``(owner, number, start, size, strand, frame, bases, residues)`` of runs of ``least`` bases or more, in their order."""
    number, residue, stop = _codes(table_id)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    found = []
    for turned in (False, True):
        laid = "".join([t + _PAD[len(t) % 3] for t in (t.translate(_COMPLEMENT)[::-1] for t in texts)] if turned else [t + _PAD[len(t) % 3] for t in texts])
        symbols = number[_symbols(laid)]
        codons = symbols[:-2] * 25 + symbols[1:-1] * 5 + symbols[2:]
        ends_here, letters = stop[codons], residue[codons] if residues else None
        first = np.cumsum(lengths // 3 + 1 + (lengths % 3 > 0)) - (lengths // 3 + 1 + (lengths % 3 > 0))
        for frame in range(3):
            ends = ends_here[frame::3].copy()
            n = np.maximum(lengths - frame, 0) // 3
            ends[(first + n - 1)[n > 0]] = True
            end = np.flatnonzero(ends)
            owner = np.searchsorted(first, end, "right") - 1
            start = np.maximum(np.concatenate([[0], end[:-1] + 1]), first[owner])
            long = np.flatnonzero((end + 1 - start) * 3 >= least)
            owner, start, end = owner[long], start[long], end[long] + 1
            cuts = zip((3 * start + frame).tolist(), (3 * end + frame).tolist()) if bases else ()
            cut = [laid[a:b] for a, b in cuts]
            line = letters[frame::3].tobytes().decode("ascii") if residues else ""
            said = [line[a:b] for a, b in zip(start.tolist(), end.tolist())] if residues else []
            found.append((owner, 3 * (start - first[owner]) + frame + 1, np.full(len(long), 3 * turned + frame), 3 * (end - start), cut, said))
    owner, start, kind, size = (np.concatenate([f[k] for f in found]) for k in range(4))
    order = np.lexsort((start, kind, owner))
    owner, start, kind, size = owner[order], start[order], kind[order], size[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left") + 1
    texts_of = [[x for f in found for x in f[k]] for k in (4, 5)]
    at = order.tolist()
    return owner, place, start, size, kind >= 3, kind % 3 + 1, *([some[k] for k in at] if some else [] for some in texts_of)


def runs_in_batches(batches: Iterator[pa.RecordBatch], table_id: int, least: int, residues: bool, bases: bool = True, tail: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of batches of ``(seq_id, seq)`` without nulls, some megabases at a time.

    With ``tail`` the batches also hold ``tails`` by sequence, and runs tell whether their last ``tail`` residues are among them.
    """
    for batch in batches:
        rows: list[int] = []
        texts: list[str] = []
        size = 0
        for k, text in enumerate(batch.column(1)):
            rows.append(k)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= AT_ONCE or k == batch.num_rows - 1:
                yield _found(batch, rows, texts, table_id, least, residues, bases, tail)
                rows, texts, size = [], [], 0


def _found(batch: pa.RecordBatch, rows: list[int], texts: list[str], table_id: int, least: int, residues: bool, bases: bool, tail: int | None) -> pa.RecordBatch:
    owner, place, start, size, turned, frame, cut, said = runs_of(texts, table_id, least, residues, bases)
    columns = {
        "seq_id": batch.column(0).take(pa.array(np.array(rows)[owner])),
        "number": pa.array(place),
        "start": pa.array(start),
        "strand": pa.array(np.where(turned, "-", "+").tolist(), pa.string()),
        "frame": pa.array(frame.astype(np.int32)),
        "size": pa.array(size.astype(np.int32)),
    }
    if bases:
        columns["nt_sequence"] = pa.array(cut, pa.string())
    if residues:
        columns["aa_sequence"] = pa.array(said, pa.string())
    if tail is not None:
        known = [set(tails or ()) for tails in batch.column("tails").take(pa.array(rows)).to_pylist()]
        # residues without stops at their end, all of them if the tail is 0
        hits = (bool(aa) and aa.rstrip("*")[-tail:] in known[k] for k, aa in zip(owner.tolist(), said))
        columns["in_genbank"] = pa.array(list(hits), pa.bool_())
    return pa.record_batch(list(columns.values()), names=list(columns))
