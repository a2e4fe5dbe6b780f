"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

Words of a corpus are counted; for the frequent ones all deletions and the
replacements by a smaller letter are generated, as hashes only (the other edits are
the same pairs seen from the other word). A hash of a word is a sum of one
number for each (place, letter), so an edit changes it in one step. Hashes are
probed against Bloom filters of the vocabulary, sharded by word length: a deletion
looks into the shard of the length below, a replacement into its own. A filter is
blocked: all bits of a word lie in one 64-bit block. Only positives are shuffled,
as hashes with the place of the edit, to a join with the vocabulary; there the
words themselves are compared, which removes false positives and collisions.

What is broadcast is bounded: a shard of more than ``SEGMENT`` words is cut by hash
into segments, and filters are broadcast in passes of at most ``PASS_BYTES``, each
pass probing only the words whose edits can lie in it. So the filters keep
their error rate at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codonlake.llm.bloom import block_and_mask, may_hold, mixed
from codonlake.session import stored

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN_END = "[^a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, DROP_EVERY = 5, 3, 97
SEGMENT = 1 << 20
BITS_EACH = 24
PASS_BYTES = 32 << 20
_AT_ONCE = 1 << 19
_POSITIVE = "source long, length int, place int, letter int, target long"


def corpus_words(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_every: int | None = DROP_EVERY
) -> DataFrame:
    """``(word, n)``: letter runs of all texts with A-Z lower-cased, of any length and count.

    With ``drop_every`` a run whose CRC-32 with its document is a multiple of it
    loses one letter, which plants misspellings. Null texts have no words; a null doc_id counts as
    the empty text.
    """
    runs = F.explode(F.split(F.translate(F.col(text), UPPER, LOWER), RUN_END)).alias("word")
    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), runs).filter("word <> ''")
    if drop_every:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))

        def shorter(at: Column) -> Column:
            return F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))

        at = F.pmod(h, F.length("word")).cast("int")
        rows = rows.select(F.when(h % drop_every == 0, shorter(at)).otherwise(F.col("word")).alias("word"))
    return rows.filter(F.length("word") >= 1).groupBy("word").agg(F.count("*").alias("n"))


def _numbers(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The number of each (place, letter)."""
    return mixed(places.astype(np.uint64) * np.uint64(512) + letters.astype(np.uint64))


def _grid(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each; letters are all below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def _by_length(words: pd.Series, least: int = 1) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Words by length, in parts of about ``_AT_ONCE`` letters: (length, rows, words)."""
    sizes = words.str.len().to_numpy(np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        length = int(sizes[order[lo]])
        if length >= least:
            step = max(1, _AT_ONCE // length)
            for at in range(lo, hi, step):
                rows = order[at : min(hi, at + step)]
                yield length, rows, words.iloc[rows].tolist()


def word_hashes(words: pd.Series) -> np.ndarray:
    """64-bit hash of each word that is not empty."""
    out = np.zeros(len(words), np.uint64)
    for length, rows, some in _by_length(words):
        out[rows] = _numbers(np.arange(length), _grid(some, length)).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(segments)


class Filters:
    """Filters of one pass: for (length, segment) an array of blocks; ``segments`` of all lengths."""

    def __init__(self, segments: dict[int, int], blocks: dict[tuple[int, int], np.ndarray]):
        self.segments, self.blocks = segments, blocks
        self.lengths = {length for length, _ in blocks}

    def have(self, length: int, h: np.ndarray) -> np.ndarray:
        """Which hashes of words of ``length`` may be in the filters of this pass."""
        found, n = np.zeros(h.shape, bool), self.segments.get(length, 0)
        for s in range(n):
            blocks = self.blocks.get((length, s))
            if blocks is None:
                continue
            hit = may_hold(blocks, h)
            found |= hit & (_segment(h, n) == s) if n > 1 else hit
        return found


def _edits(length: int, grid: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter or -1 for a deletion, hash) of edits that the filters may hold."""
    places, rows = np.arange(length), len(grid)
    own = _numbers(places, grid)
    whole = own.sum(axis=1, dtype=np.uint64)
    if length - 1 in filters.lengths:
        # Letters behind a deleted one move up by one place. Of a run of equal letters the first goes.
        moved = np.zeros_like(own)
        moved[:, 1:] = _numbers(places[:-1], grid[:, 1:])
        ahead = np.cumsum(own, axis=1, dtype=np.uint64) - own
        behind = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
        h = ahead + behind
        first = np.ones(grid.shape, bool)
        first[:, 1:] = grid[:, 1:] != grid[:, :-1]
        r, p = np.nonzero(filters.have(length - 1, h) & first)
        yield r, p, np.full(len(r), -1), h[r, p]
    if length in filters.lengths:
        for letter in map(ord, LETTERS):
            new = _numbers(places, np.full(length, letter))
            h = whole[:, None] - own + new
            r, p = np.nonzero((grid > letter) & filters.have(length, h))
            yield r, p, np.full(len(r), letter), h[r, p]


def _filter_blocks(words: DataFrame, segments: dict[int, int], sizes: dict[tuple[int, int], int]) -> DataFrame:
    """``(length, segment, block, bits)`` of the filters in ``sizes``; bits of a block are joined in Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = batch["h"].to_numpy(np.int64).view(np.uint64)
            length = batch["length"].to_numpy(np.int64)
            for at in np.unique(length).tolist():
                mine = h[length == at]
                part = _segment(mine, segments[at])
                for s in np.unique(part).tolist():
                    if (at, s) in sizes:
                        block, mask = block_and_mask(mine[part == s], sizes[at, s])
                        yield pd.DataFrame({"length": at, "segment": s, "block": block.view(np.int64), "bits": mask.view(np.int64)})

    found = words.select("h", "length").mapInPandas(run, "length int, segment int, block long, bits long")
    return found.groupBy("length", "segment", "block").agg(F.bit_or("bits").alias("bits"))


def _passes(counts: list[tuple[int, int]], segment: int, pass_bytes: int) -> tuple[dict[int, int], list[dict]]:
    """Segments of each length, and passes: blocks of each (length, segment), at most ``pass_bytes`` together."""
    segments = {length: -(-n // segment) for length, n in counts}
    passes, room = [], 0
    for length, n in counts:
        each = max(64, -(-n // segments[length]) * BITS_EACH // 64 + 1)
        for s in range(segments[length]):
            if not passes or each * 8 > room:
                passes.append({})
                room = pass_bytes
            passes[-1][length, s] = each
            room -= each * 8
    return segments, passes


def near_words(words: DataFrame, segment: int = SEGMENT, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(word, near)``: all ordered pairs of ``words (word, n)`` that differ by one inserted, deleted or replaced letter.

    Words are distinct, not empty and of the letters in ``LETTERS``. A pair comes once in each order.
    """
    spark = words.sparkSession

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(h=word_hashes(batch["word"]), length=batch["word"].str.len().astype(np.int32))

    known = stored(words.select("word").mapInPandas(hashed, "word string, h long, length int"), "spelling-words")
    counts = [tuple(r) for r in known.groupBy("length").count().orderBy("length").collect()]  # one row for each length
    segments, passes = _passes(counts, segment, pass_bytes)
    positives = None
    for sizes in passes:
        rows = _filter_blocks(known, segments, sizes).toPandas()  # at most pass_bytes of bits
        blocks = {}
        for key, some in rows.groupby(["length", "segment"]):
            bits = np.zeros(sizes[key], np.uint64)
            bits[some["block"].to_numpy()] = some["bits"].to_numpy(np.int64).view(np.uint64)
            blocks[key] = bits
        shared = spark.sparkContext.broadcast(Filters(segments, blocks))

        def probed(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                h = batch["h"].to_numpy(np.int64)
                for length, rows, some in _by_length(batch["word"]):
                    for r, place, letter, target in _edits(length, _grid(some, length), shared.value):
                        yield pd.DataFrame(
                            {
                                "source": h[rows[r]],
                                "length": np.int32(length),
                                "place": place.astype(np.int32),
                                "letter": letter.astype(np.int32),
                                "target": target.view(np.int64),
                            }
                        )

        touched = {n + d for n, _ in sizes for d in (0, 1)}
        some = known.filter(F.col("length").between(min(touched), max(touched)))
        found = some.select("word", "h").mapInPandas(probed, _POSITIVE)
        positives = found if positives is None else positives.unionByName(found)
    if positives is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    aim = known.select(F.col("h").alias("target"), F.col("word").alias("near"), F.col("length").alias("near_length"))
    deleted = F.col("letter") < 0
    hits = positives.join(aim, "target").filter(F.col("near_length") == F.col("length") - deleted.cast("int"))
    # Verified on the words: hashes only propose.
    whole = hits.join(known.select(F.col("h").alias("source"), "word", F.col("length").alias("own")), "source")
    start, rest = F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2, length)")
    letter = F.when(deleted, "").otherwise(F.chr("letter"))
    true = (F.col("own") == F.col("length")) & (F.col("near") == F.concat(start, letter, rest))
    if_changed = deleted | (F.expr("substring(word, place + 1, 1)") > letter)
    pairs = stored(whole.filter(true & if_changed).select("word", "near"), "spelling-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of ``words (word, n)``.

    ``form`` is the near word of largest n (ties: smallest word) if that is at
    least ``ratio`` times the word's own; ``root`` follows forms to the last. As n grows by
    ``ratio`` at each step, chains are short and ring-free; places double each round.
    """
    sized = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    around = near_words(words).join(sized, "near").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    full = words.join(around, "word", "left")
    follows = -F.col("best.minus") >= ratio * F.col("n")
    table = stored(
        full.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(follows, F.col("best.form")).alias("form"),
            F.when(follows, -F.col("best.minus")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = table.filter("form IS NOT NULL").select("word", F.col("form").alias("end"))
    while True:
        ahead = ends.select(F.col("word").alias("end"), F.col("end").alias("further"))
        ends = stored(
            ends.join(ahead, "end", "left").select("word", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if ends.filter("moved").isEmpty():
            break
    return table.join(ends.select("word", "end"), "word", "left").select(
        "word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants among the frequent words of ``df``: at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences.

    Only the two named columns are read. No texts or no frequent words give an empty table.
    Repeated rows are documents of their own.
    """
    every = corpus_words(df, doc_id, text).filter(F.length("word") >= LEAST_LENGTH).filter(F.col("n") >= LEAST_COUNT)
    return variants(stored(every, "spelling-vocabulary"))
