"""Phrase collocations by a multikey three-way quicksort of suffixes.

Every place in a text where a frequent word starts is a suffix, read up to
``DEPTH`` words. Suffixes are routed over the cluster by their leading words (a range
partitioning on all their words, so a leading word or pair that starts a third of
them is split by the words that follow), and each task sorts its range: a partition of
suffixes that agree on their first d words is split by its next word into smaller,
equal and larger; the size of an equal partition is the count of a phrase. Partitions
below the least count are abandoned, but for those at the two edges of a range, which
may go on in the next task; their counts are added up after the sort.

Leading pairs are routed and counted first, and those below the least count abandoned:
a suffix ends before a pair that a Bloom filter of the others, of fixed size, does not hold. When
that filter gets full it only shortens fewer suffixes; counts stay exact.

Words are symbols: the ``DICTIONARY`` most frequent ones are numbered (that table is
broadcast, its size is bounded by the parameter), other frequent ones go by a 63-bit hash
that is checked to be unique. A word below the least count ends a suffix, as no
phrase with it can be frequent; words beyond the dictionary are tested by a Bloom filter of
fixed size first, which may let a rare word through (a longer suffix, the same
counts) but never stops a frequent one. Equal suffixes of a block of text are one row with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codonlake.llm.bloom import block_and_mask, may_hold
from codonlake.session import stored

DEPTH = 5
LEAST = 100
TOP = 2000
DICTIONARY = 1 << 17
LONGEST_ENTRY = 64
FILTER_BLOCKS = 1 << 21
ROWS_A_TASK = 1 << 20
_BLOCK_BYTES = 4 << 20
_ROWS_AT_ONCE = 1 << 21
_FOLD = (1 << 24) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
_ROW = "a long, b long, n int, tail binary"
_COUNTS = "s1 long, s2 long, s3 long, s4 long, s5 long, n long"


def _lang(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def word_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, word, n)`` of all words; a null language is ``und``, a null text has no words."""
    words = F.split(F.translate(F.col(text), _UPPER, _LOWER), r"[.,;:!?\x0A-\x0D\x20\x09]+")
    rows = df.select(_lang(F.col(lang)).alias("lang"), F.explode(words).alias("word"))
    return rows.filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


def _hash_symbol(salt: int) -> Column:
    h = F.xxhash64(F.concat_ws("\t", F.lit(str(salt)), "lang", "word"))
    return F.lit(-1) - F.shiftrightunsigned(h, 1)


def symbols(words: DataFrame, least: int, dictionary: int) -> tuple[DataFrame, int]:
    """``(lang, word, n, symbol)`` of words counted ``least`` times or more, and the salt of the hashes.

    The first by count have positive symbols, the others negative hashes that no
    other word of the corpus shares: the salt is raised until that holds.
    """
    frequent = words.filter(F.col("n") >= least)
    order = [F.col("n").desc(), F.col("lang"), F.col("word")]
    top = frequent.filter(F.octet_length("word") <= LONGEST_ENTRY).orderBy(*order).limit(dictionary)
    top = stored(top.select("*", F.row_number().over(W.orderBy(*order)).cast("long").alias("symbol")), "phrase-dictionary")
    named = top.select("lang", "word", "symbol")
    rest = frequent.join(named.drop("symbol"), ["lang", "word"], "left_anti")
    salt = 0
    if not rest.isEmpty():
        beyond = words.join(named.drop("symbol"), ["lang", "word"], "left_anti")
        while not beyond.groupBy(_hash_symbol(salt).alias("symbol")).count().filter("count > 1").isEmpty():
            salt += 1
    return stored(top.unionByName(rest.withColumn("symbol", _hash_symbol(salt))), "phrase-symbols"), salt


class Reader:
    """Turns texts into symbols; words without one, and stops, are 0."""

    def __init__(self, known: dict[str, dict[bytes, int]], bits: np.ndarray | None, salt: int):
        self.known, self.bits, self.salt = known, bits, salt

    def read(self, lang: str, texts: list[bytes]) -> np.ndarray:
        data = b" . ".join(texts).lower().translate(_STOPS).replace(b".", b" . ")
        tokens, known = data.split(), self.known.get(lang, {})
        out = np.fromiter((known.get(t, 0) for t in tokens), np.int64, len(tokens))
        if self.bits is not None:
            open_at = [k for k in np.flatnonzero(out == 0).tolist() if tokens[k] != b"."]
            words = sorted({tokens[k] for k in open_at})
            start = f"{self.salt}\t{lang}\t".encode()
            h = np.array([xxhash.xxh64_intdigest(start + w, 42) for w in words], np.uint64)
            symbol = -1 - (h >> np.uint64(1)).astype(np.int64)
            held = may_hold(self.bits, symbol.view(np.uint64))
            found = {w: s for w, s, good in zip(words, symbol.tolist(), held.tolist()) if good}
            for k in open_at:
                out[k] = found.get(tokens[k], 0)
        return out


def _folded(s: np.ndarray, dictionary: int) -> np.ndarray:
    """24 bits of each symbol, a number of the dictionary as it is."""
    return np.where(s >= 0, s, dictionary + 1 + (-1 - s) % (_FOLD - dictionary))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, some megabytes together or one longer text."""
    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = data.as_py()
            waiting.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] >= _BLOCK_BYTES:
                yield lang, waiting.pop(lang)
                size[lang] = 0
        yield from waiting.items()


def _pair_keys(s: np.ndarray, dictionary: int) -> np.ndarray:
    """48 bits of each symbol with the next one; 0 unless both are words."""
    f = _folded(s, dictionary)
    key = np.zeros(len(s), np.int64)
    key[:-1] = np.where((s[:-1] != 0) & (s[1:] != 0), (f[:-1] << 24) | f[1:], 0)
    return key


def _pair_rows(reader: Reader, blocks: Iterator[tuple[str, list[bytes]]], dictionary: int) -> Iterator[pa.RecordBatch]:
    """``(key, n)`` of the pairs of many blocks, combined within a bounded table."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lang, texts in blocks:
        new, n = np.unique(_pair_keys(reader.read(lang, texts), dictionary), return_counts=True)
        keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) >= _ROWS_AT_ONCE:
            yield pa.record_batch([pa.array(keys), pa.array(counts)], names=["key", "n"])
            keys, counts = keys[:0], counts[:0]
    yield pa.record_batch([pa.array(keys), pa.array(counts)], names=["key", "n"])


def _packed(s: np.ndarray, dictionary: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of two words or more: two numbers each, and their symbols."""
    keys, back = np.unique(_pair_keys(s, dictionary), return_inverse=True)
    goes_on = np.concatenate([((keys != 0) & may_hold(pairs, keys.view(np.uint64)))[back], np.zeros(DEPTH, bool)])
    padded = np.concatenate([s, np.zeros(DEPTH, np.int64)])
    at = np.flatnonzero(goes_on)
    grid, on = np.zeros((len(at), DEPTH), np.int64), np.ones(len(at), bool)
    for d in range(DEPTH):
        grid[:, d] = np.where(on, padded[at + d], 0)
        on &= goes_on[at + d]
    f = _folded(grid, dictionary)
    a = (f[:, 0] << 39) | (f[:, 1] << 15) | (f[:, 2] >> 9)
    return a, ((f[:, 2] & 511) << 48) | (f[:, 3] << 24) | f[:, 4], grid


def _suffix_rows(reader: Reader, blocks: Iterator[tuple[str, list[bytes]]], dictionary: int, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Suffixes of many blocks, combined within a bounded table; those with hashes among them come with whole symbols."""
    table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray, tails: list[bytes | None]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(n.astype(np.int32)), pa.array(tails, pa.binary())], names=["a", "b", "n", "tail"])

    for lang, texts in blocks:
        a, b, grid = _packed(reader.read(lang, texts), dictionary, pairs)
        hashed = (grid < 0).any(axis=1)
        ones = np.ones(len(a), np.int64)
        if hashed.any():
            yield rows(a[hashed], b[hashed], ones[hashed], [row.tobytes() for row in grid[hashed]])
        table = _combined(*(np.concatenate([old, new[~hashed]]) for old, new in zip(table, (a, b, ones))))
        if len(table[0]) >= _ROWS_AT_ONCE:
            yield rows(*table, [None] * len(table[0]))
            table = tuple(x[:0] for x in table)
    yield rows(*table, [None] * len(table[0]))


def _combined(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one, with the sum of their counts."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], np.add.reduceat(n, at) if len(at) else n


def _texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(_lang(F.col(lang)).alias("lang"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL")


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """Bloom filter of ``FILTER_BLOCKS`` blocks of a table of one column of longs; joined in Spark, at most that many rows come here."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mask = block_and_mask(batch.column(0).to_numpy().view(np.uint64), FILTER_BLOCKS)
            yield pa.record_batch([pa.array(at.view(np.int64)), pa.array(mask.view(np.int64))], names=["block", "bits"])

    rows = hashes.mapInArrow(blocks, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BLOCKS, np.uint64)
    bits[rows["block"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def suffixes(df: DataFrame, reader: Reader, least: int, dictionary: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """Packed suffixes of all texts, as far as their pairs of words are frequent."""
    context = df.sparkSession.sparkContext
    shared = context.broadcast(reader)
    pairs = _texts(df, text, lang).mapInArrow(lambda it: _pair_rows(shared.value, _blocks(it), dictionary), "key long, n long")
    frequent = pairs.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")
    held = context.broadcast(_filter_of(frequent))

    return _texts(df, text, lang).mapInArrow(lambda it: _suffix_rows(shared.value, _blocks(it), dictionary, held.value), _ROW)


def three_way_counts(grid: np.ndarray, weight: np.ndarray, open_depth: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, depth, count) of the partitions of equal suffixes with two words or more.

    ``grid`` holds a suffix a row, 0 after its end; ``weight`` how often it occurs;
    ``open_depth`` how many first words of it may go on in another task: such partitions are
    reported whatever their count. All partitions of a round are split at once, each by its own pivot.
    """
    at, size, depth = np.arange(len(grid)), np.array([len(grid)]), np.array([0])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        part = np.repeat(np.arange(len(size)), size)
        key = grid[at, depth[part]]
        end = np.cumsum(size)
        trio = np.stack([key[end - size], key[end - size + size // 2], key[end - 1]])
        pivot = np.sort(trio, axis=0)[1][part]
        side = part * 3 + (key >= pivot) + (key > pivot)
        order = np.argsort(side, kind="stable")
        at, side = at[order], side[order]
        start = np.flatnonzero(np.diff(side, prepend=-1))
        size = np.diff(np.append(start, len(at)))
        total = np.add.reduceat(weight[at], start)
        equal = side[start] % 3 == 1
        depth = depth[side[start] // 3]
        first = at[start]
        stopped = equal & (grid[first, depth] == 0)
        depth = depth + equal
        needed = np.where(equal, depth, depth + 1)
        kept = ((total >= least) | (np.maximum.reduceat(open_depth[at], start) >= needed)) & ~stopped
        said = kept & equal & (depth >= 2)
        found.append((first[said], depth[said], total[said]))
        on = kept & (depth < DEPTH)
        at, size, depth = at[np.repeat(on, size)], size[on], depth[on]
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3)) if found else (at, at, at)


def _sorted_range(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Phrase counts of one range of suffixes."""
    a, b, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, rows, hashed = [], 0, []

    def merge() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _combined(*(np.concatenate([x, *(w[k] for w in waiting)]) for k, x in enumerate((a, b, n))))

    for batch in batches:
        plain = batch.filter(batch.column("tail").is_null())
        waiting.append([plain.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n")])
        rows += len(plain)
        rest = batch.filter(batch.column("tail").is_valid())
        if len(rest):
            tails = np.frombuffer(b"".join(rest.column("tail").to_pylist()), np.int64).reshape(len(rest), DEPTH)
            hashed.append((*(rest.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n")), tails))
        if rows > max(ROWS_A_TASK, len(a)):  # equal rows of many blocks fold into one
            (a, b, n), waiting, rows = merge(), [], 0
    a, b, n = merge()
    grid = np.stack([a >> 39, (a >> 15) & _FOLD, ((a & 0x7FFF) << 9) | (b >> 48), (b >> 24) & _FOLD, b & _FOLD], axis=1)
    folds = [grid]
    for ha, hb, _, _ in hashed:
        folds.append(np.stack([ha >> 39, (ha >> 15) & _FOLD, ((ha & 0x7FFF) << 9) | (hb >> 48), (hb >> 24) & _FOLD, hb & _FOLD], axis=1))
    fold = np.concatenate(folds)
    if not len(fold):
        return
    grid = np.concatenate([grid, *(h[3] for h in hashed)])
    weight = np.concatenate([n, *(h[2] for h in hashed)])
    order = np.lexsort(fold.T[::-1])
    edge = np.zeros(len(fold), np.int64)
    for row in (fold[order[0]], fold[order[-1]]):
        edge = np.maximum(edge, np.cumprod(fold == row, axis=1).sum(axis=1))
    first, depth, count = three_way_counts(grid, weight, edge, least)
    out = np.where(np.arange(DEPTH) < depth[:, None], grid[first], 0)
    yield pa.record_batch([*(pa.array(out[:, k]) for k in range(DEPTH)), pa.array(count)], names=["s1", "s2", "s3", "s4", "s5", "n"])


def phrase_counts(df: DataFrame, named: DataFrame, salt: int, least: int, dictionary: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(p, a)``: phrases of 2 to ``DEPTH`` words as arrays of symbols, and how often they occur, if ``least`` times or more."""
    known: dict[str, dict[bytes, int]] = {}
    for row in named.filter("symbol > 0").select("lang", "word", "symbol").toLocalIterator():  # at most `dictionary` short words
        known.setdefault(row[0], {})[row[1].encode()] = row[2]
    beyond, bits = named.filter("symbol < 0"), None
    if not beyond.isEmpty():
        bits = _filter_of(beyond.select("symbol"))
    packed = stored(suffixes(df, Reader(known, bits, salt), least, dictionary, text, lang), "phrase-suffixes")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-packed.count() // ROWS_A_TASK))
    routed = packed.repartitionByRange(tasks, "a", "b")
    parts = routed.mapInArrow(lambda batches: _sorted_range(batches, least), _COUNTS)
    keys = [f"s{k}" for k in range(1, DEPTH + 1)]
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    return whole.select(F.array_remove(F.array(*keys), 0).alias("p"), "a")


def collocations(
    df: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", dictionary: int = DICTIONARY
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best collocations of each language.

    A phrase is scored by its weakest cut (ties: the first). One contained in a longer
    candidate of the same count is dropped; as counts fall with length, looking at candidates
    one word longer is enough. Null texts have no words, a null language is ``und``; repeated
    rows count as often as they are there, other columns are not read. Without candidates the table is empty.
    """
    words = stored(word_counts(df, text, lang), "phrase-words")
    named, salt = symbols(words, least, dictionary)
    found = stored(phrase_counts(df, named, salt, least, dictionary, text, lang), "phrase-candidates")
    n = F.size("p")
    longer = found.filter(n > 2).select(F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), "a")
    longer = longer.groupBy("p").agg(F.max("a").alias("within"))
    kept = found.join(longer, "p", "left").filter(F.col("within").isNull() | (F.col("within") < F.col("a"))).select("p", "a")
    spelled = (
        kept.select("p", "a", F.posexplode("p").alias("at", "symbol"))
        .join(named.select("symbol", "lang", "word"), "symbol")
        .groupBy("p", "a")
        .agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("p", "a", "lang", F.array_join(F.col("words.word"), " ").alias("phrase"))
    )
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = found.unionByName(named.select(F.array("symbol").alias("p"), F.col("n").alias("a")))
    cuts = spelled.select("*", F.explode(F.sequence(F.lit(1), n - 1)).alias("k")).select(
        "*", F.expr("slice(p, 1, k)").alias("left"), F.expr("slice(p, k + 1, size(p) - k)").alias("right")
    )
    cuts = cuts.join(counts.select(F.col("p").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("p").alias("right"), F.col("a").alias("r")), "right").join(totals, "lang")
    score = F.expr("(1000 * CAST(a AS decimal(17,0)) * CAST(n AS decimal(17,0))) div (CAST(l AS decimal(17,0)) * CAST(r AS decimal(17,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    place = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
