"""Exact removal of repeated byte strings by a distributed suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else.

1. Anchors: positions whose 16-byte hash is least in some window of ``REACH``
   positions. Every string of ``LENGTH`` bytes has one among its first ``REACH`` bytes,
   at the same place wherever the string stands. What follows an anchor in any such
   string is its core of ``LENGTH - REACH`` bytes; Spark counts cores by hash, and
   only anchors whose core occurs twice go on.
2. Their contexts (the core, and up to ``REACH`` bytes on either side, in which all strings
   led by the anchor lie) are counted by a 128-bit digest of the bytes. A context
   that occurs twice is repeated as a whole, and hot ones shrink to one row.
3. Contexts with one core meet in a task. The suffixes that follow the core and
   the prefixes before it, backwards, are merge-sorted; a comparison finds the
   common extension by binary search on prefix polynomial hashes, so it takes a
   logarithmic number of steps. Two contexts share a string if they lie in one run of long enough
   extensions in both orders; the bytes are then compared. Cores with more
   than ``MAX_CONTEXTS`` contexts go another exact way: their strings are counted
   by digest, which Spark adds up before it shuffles.
4. What a context has repeated goes back to the places where it occurs.

Only documents with an anchor left after step 1 carry their text beyond it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codonlake.session import scratch_path, stored

LENGTH = 400
REACH = 128
GRAM = 16
MAX_CONTEXTS = 20_000
_AT_ONCE = 1 << 22
_MEMBERS_AT_ONCE = 4000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_known = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of a base, modulo 2^64."""
    while len(_known[base]) <= n:
        known = _known[base]
        _known[base] = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    return _known[base]


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A stored table that holds texts, packed more tightly than others."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


class Hashes:
    """Prefix polynomial hashes of a byte array; equal strings have equal hashes, in whatever array they stand."""

    def __init__(self, data: np.ndarray):
        self.data, self.n = data, len(data)
        self.inverse = _powers(_INVERSE, self.n)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_VALUES[data] * _powers(_BASE, self.n)[: self.n], out=self.prefix[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def every(self, length: int) -> np.ndarray:
        """Hash of each string of a length."""
        n = max(0, self.n + 1 - length)
        return (self.prefix[length:] - self.prefix[:n]) * self.inverse[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each window of a width, in linear time."""
    take, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = take.accumulate(rows, axis=1).ravel()
    behind = take.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(hashes: Hashes, reach: int = REACH) -> np.ndarray:
    """Positions whose gram is least in some window of ``reach`` positions."""
    if hashes.n < reach + GRAM:
        return np.zeros(0, np.int64)
    grams = _mixed(hashes.every(GRAM))
    edge = np.zeros(reach - 1, np.uint64)
    padded = np.concatenate([edge, _sliding(grams, reach, True), edge])
    return np.flatnonzero(_sliding(padded, reach, False)[: len(grams)] == grams)


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows and texts, some megabytes at a time; texts too short to matter are left out."""
    rows, texts, size = [], [], 0
    for i, value in enumerate(batch.column(column)):
        data = value.as_buffer().to_pybytes() if value.is_valid else b""
        if len(data) >= LENGTH:
            rows.append(i)
            texts.append(data)
            size += len(data)
        if size >= _AT_ONCE:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    core_length = LENGTH - REACH
    for batch in batches:
        for rows, texts in _parts(batch, "text"):
            hashes = Hashes(np.frombuffer(b"".join(texts), np.uint8))
            ends = np.cumsum([len(t) for t in texts])
            at = anchors(hashes)
            owner = np.searchsorted(ends, at, "right")
            inside = at + core_length <= ends[owner]
            at, owner = at[inside], owner[inside]
            core = _mixed(hashes.of(at, core_length)).view(np.int64)
            place = at - np.concatenate([[0], ends[:-1]])[owner]
            row = pa.array(np.array(rows)[owner])
            yield pa.RecordBatch.from_arrays(
                [pa.array(core), batch.column("id").take(row), batch.column("version").take(row), pa.array(place.astype(np.int32))],
                names=["core", "id", "version", "place"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    core_length = LENGTH - REACH
    for batch in batches:
        places = batch.column("places")
        for i in range(batch.num_rows):
            data = batch.column("text")[i].as_buffer().to_pybytes()
            at = np.unique(places[i].values.to_numpy(zero_copy_only=False)).astype(np.int64)
            hashes = Hashes(np.frombuffer(data, np.uint8))
            core = _mixed(hashes.of(at, core_length)).view(np.int64)
            starts = np.maximum(0, at - REACH + 1).tolist()
            found = [data[s : a + LENGTH] for s, a in zip(starts, at.tolist())]
            left = (at - starts).astype(np.int32)
            keys = [xxhash.xxh3_128_digest(c, seed=int(n)) for c, n in zip(found, left)]
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(core),
                    pa.array(keys, pa.binary()),
                    pa.array(found, pa.binary()),
                    pa.array(left),
                    batch.column("id").take(pa.array([i] * n)),
                    batch.column("version").take(pa.array([i] * n)),
                    pa.array(at.astype(np.int32)),
                ],
                names=["core", "key", "context", "left", "id", "version", "place"],
            )


def removed_spans(places: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int]]:
    """Union of ``[place - before, place + after)`` as maximal runs."""
    starts, ends = places - before, places + after
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[cut].tolist(), ends[np.append(cut[1:] - 1, len(ends) - 1)].tolist()))


def sorted_suffixes(hashes: Hashes, start: np.ndarray, size: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings, by segment and then by their bytes, and what each shares with the one before it.

    Strings begin at ``start`` and have ``size`` bytes; ``segment`` is rising. Bottom-up
    merge sort of all segments at once: an element's place in a merged pair of
    runs is its place in its own run plus its rank in the other.
    """
    first = np.searchsorted(segment, segment, "left")
    members = np.searchsorted(segment, segment, "right") - first
    order, width = np.arange(len(start)), 1
    index = order - first
    while (members > width).any():
        run = index // width
        low = first + np.minimum((run ^ 1) * width, members)
        high = first + np.minimum((run ^ 1) * width + width, members)
        begin, own = low.copy(), np.flatnonzero(high > low)
        while len(own):
            middle = (low[own] + high[own]) // 2
            sign = _compared(hashes, start, size, order[own], order[middle])[0]
            after = np.where(run[own] & 1, sign >= 0, sign > 0)
            low[own] = np.where(after, middle + 1, low[own])
            high[own] = np.where(after, high[own], middle)
            own = own[low[own] < high[own]]
        target = first + (run & ~1) * width + index % width + (low - begin)
        merged = np.empty_like(order)
        merged[target] = order
        order, width = merged, 2 * width
    shared = np.full(len(order), -1, np.int64)
    inner = np.flatnonzero(segment[1:] == segment[:-1]) + 1
    shared[inner] = _compared(hashes, start, size, order[inner - 1], order[inner])[1]
    return order, shared


def _compared(hashes: Hashes, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of the comparison of strings, and their common extension by binary search; a string's end comes before any byte."""
    most = np.minimum(size[a], size[b])
    low, high = np.zeros(len(a), np.int64), most.copy()
    i = np.flatnonzero(high > 0)
    while len(i):
        middle = (low[i] + high[i] + 1) // 2
        same = hashes.of(start[a[i]], middle) == hashes.of(start[b[i]], middle)
        low[i] = np.where(same, middle, low[i])
        high[i] = np.where(same, high[i], middle - 1)
        i = i[low[i] < high[i]]
    sign = np.sign(size[a] - size[b])
    i = np.flatnonzero(low < most)
    byte = lambda x: hashes.data[start[x[i]] + low[i]].astype(np.int64)
    sign[i] = np.sign(byte(a) - byte(b))
    return sign, low


def repeated_in(groups: np.ndarray, contexts: list[bytes], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest and shortest distance to its anchor at which a context's string also stands in another of its group.

    ``groups`` is rising; -1 stands for none. What follows the cores is sorted,
    and what precedes them, read backwards. Strings at a distance d are equal if
    their contexts share d bytes before and ``REACH - d`` bytes after the core: in either order
    such contexts are neighbours, in a run of common extensions that long.
    """
    left = left.astype(np.int64)
    sizes = np.array([len(c) for c in contexts], np.int64)
    core = LENGTH - REACH
    both = [b"".join(c[n + core :] for c, n in zip(contexts, left)), b"".join(c[:n][::-1] for c, n in zip(contexts, left))]
    sides = []
    for text, size in zip(both, (sizes - left - core, left)):
        hashes = Hashes(np.frombuffer(text, np.uint8))
        sides.append(sorted_suffixes(hashes, np.cumsum(size) - size, size, groups))
    longest, shortest = np.full((2, len(contexts)), -1)
    partner = np.zeros((2, len(contexts)), np.int64)
    for distance in range(REACH):
        run = []
        for (order, shared), length in zip(sides, (REACH - distance, distance)):
            runs = np.empty(len(order), np.int64)
            runs[order] = np.cumsum(shared < length)
            run.append(runs)
        key = run[0] * (len(contexts) + 1) + run[1]
        order = np.argsort(key, kind="stable")
        equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        # in a run of one context nothing is shared, so two with one key are both long enough
        for x, y in ((order[equal], order[equal + 1]), (order[equal + 1], order[equal])):
            longest[x], partner[0, x] = distance, y
            new = shortest[x] < 0
            shortest[x[new]], partner[1, x[new]] = distance, y[new]
    _verify(contexts, left, (longest, shortest), partner)
    return longest, shortest


def _verify(contexts: list[bytes], left: np.ndarray, distances: tuple, partner: np.ndarray) -> None:
    """Compare the bytes of the outermost strings found equal."""
    for found, other in zip(distances, partner):
        for i in np.flatnonzero(found >= 0).tolist():
            j, d = int(other[i]), int(found[i])
            a, b = int(left[i]) - d, int(left[j]) - d
            if contexts[i][a : a + LENGTH] != contexts[j][b : b + LENGTH]:
                raise ArithmeticError("two strings share a hash; change the base of the polynomial")


def _sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated distances of contexts; rows come sorted by core, and whole groups go through some thousands at a time."""
    left = None
    for batch in batches:
        rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
        core = rows["core"].to_numpy()
        new = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
        left, whole, at = rows.iloc[new[-1] :], int(new[-1]), 0
        while at < whole:
            fit = new[new <= max(at + _MEMBERS_AT_ONCE, new[np.searchsorted(new, at, "right")])]
            upto = min(whole, int(fit[-1]))
            yield _found(rows.iloc[at:upto])
            at = upto
    if left is not None:
        yield _found(left)


def _found(rows: pd.DataFrame) -> pd.DataFrame:
    core = rows["core"].to_numpy()
    many = np.repeat(*(lambda u: (u[1] > 1, u[1]))(np.unique(core, return_counts=True)))
    order = np.argsort(core, kind="stable")
    rows = rows.iloc[order[many]]
    if not len(rows):
        return pd.DataFrame({"core": [], "key": [], "longest": [], "shortest": []})
    longest, shortest = repeated_in(rows["core"].to_numpy(), rows["context"].tolist(), rows["left"].to_numpy())
    found = longest >= 0
    return pd.DataFrame(
        {"core": rows["core"].to_numpy()[found], "key": rows["key"].to_numpy()[found], "longest": longest[found], "shortest": shortest[found]}
    )


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each string of a hot core's contexts."""
    for batch in batches:
        for core, key, context, left in zip(batch["core"], batch["key"], batch["context"], batch["left"]):
            distances = range(max(0, left + LENGTH - len(context)), left + 1)
            yield pd.DataFrame(
                {
                    "string": [xxhash.xxh3_128_digest(context[left - d : left - d + LENGTH]) for d in distances],
                    "distance": list(distances),
                    "core": core,
                    "key": key,
                }
            )


def repeated_contexts(classes: DataFrame, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``(core, key, longest, shortest)`` of contexts with a string that occurs twice.

    ``classes`` holds each distinct context once, with the number of its places.
    """
    size = F.length("context")
    least = F.greatest(F.lit(0), F.col("left") + LENGTH - size)
    whole = classes.filter((F.col("n") > 1) & (size >= LENGTH)).select(
        "core", "key", F.col("left").cast("long").alias("longest"), least.cast("long").alias("shortest")
    )
    per_core = classes.groupBy("core").agg(F.count("*").alias("members"))
    hot = stored(per_core.filter(F.col("members") > max_contexts).select("core"), "hot-cores")
    columns = ["core", "key", "context", "left"]
    usual = classes.join(hot, "core", "left_anti").select(*columns)
    dealt = usual.repartition("core").sortWithinPartitions("core")
    found = dealt.mapInPandas(_sorted_groups, "core long, key binary, longest long, shortest long")
    strings = classes.join(hot, "core", "left_semi").select(*columns).mapInPandas(
        _strings, "string binary, distance int, core long, key binary"
    )
    twice = strings.groupBy("core", "string", "distance").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    counted = (
        strings.join(twice, ["core", "string", "distance"])
        .groupBy("core", "key")
        .agg(F.max("distance").cast("long").alias("longest"), F.min("distance").cast("long").alias("shortest"))
    )
    every = whole.unionByName(found).unionByName(counted)
    return every.groupBy("core", "key").agg(F.max("longest").alias("longest"), F.min("shortest").alias("shortest"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            value, spans = batch.column("text")[i], batch.column("spans")[i]
            data = value.as_buffer().to_pybytes() if value.is_valid else b""
            runs = []
            if spans.is_valid and len(spans):
                fields = spans.values
                place, longest, shortest = (fields.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "longest", "shortest"))
                runs = removed_spans(place, longest, LENGTH - shortest)
            kept, at = [], 0
            for s, e in runs:
                kept.append(data[at:s])
                at = e
            rest = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))] if out else None
        if out:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            )


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_contexts: int = MAX_CONTEXTS, keep_text: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, and ``kept_text`` if asked for.

    A null text counts as empty; texts shorter than ``LENGTH`` bytes stay. Rows that repeat
    are documents of their own, so each loses all that the other repeats.
    ``kept_text`` leaves out characters that a cut has split.
    """
    docs = df.select(
        F.col(doc_id).alias("id"), F.hash(text).alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    places = docs.mapInArrow(_cores, f"core long, id {dict(docs.dtypes)['id']}, version int, place int")
    cores = stored(places.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "repeated-cores")
    left_over = places.join(cores, "core").groupBy("id", "version").agg(F.collect_set("place").alias("places"))
    named = left_over.select(F.col("id").alias("__id"), F.col("version").alias("__version"), "places")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version"))
    joined = docs.join(named, same, "left").drop("__id", "__version")
    untouched = F.col("places").isNull()
    # documents that nothing can be cut from are done here
    split = _kept(
        joined.select(
            "id",
            "version",
            "places",
            F.when(~untouched | F.lit(keep_text), F.col("text")).alias("text"),
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(untouched, F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
        ),
        "documents-with-anchors",
    )
    open_ones = split.filter(~untouched)
    contexts = _kept(
        open_ones.select("id", "version", "text", "places").mapInArrow(
            _contexts,
            f"core long, key binary, context binary, left int, id {dict(docs.dtypes)['id']}, version int, place int",
        ),
        "contexts",
    )
    counts = contexts.groupBy("core", "key").agg(F.count("*").alias("n"), F.first("context").alias("context"), F.first("left").alias("left"))
    found = stored(repeated_contexts(_kept(counts, "distinct-contexts"), max_contexts), "repeated-contexts")
    spans = (
        contexts.select("core", "key", "id", "version", "place")
        .join(found, ["core", "key"])
        .groupBy("id", "version")
        .agg(F.collect_set(F.struct("place", "longest", "shortest")).alias("spans"))
        .select(F.col("id").alias("__id"), F.col("version").alias("__version"), "spans")
    )
    cut = open_ones.select("id", "version", "text").join(spans, same, "left").select("id", "text", "spans").mapInArrow(
        _cut,
        f"id {dict(docs.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string",
    )
    zero = F.lit(0).cast("long")
    rest = split.filter(untouched).select(
        "id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.col("text").alias("kept_text")
    )
    every = rest.unionByName(cut).withColumnRenamed("id", "doc_id")
    return every if keep_text else every.drop("kept_text")
