"""SimHash near-duplicates: a self-join of binary tries that start with exact blocks.

Two 64-bit fingerprints that differ in at most four bits agree in at least two
of six blocks. So there are fifteen tries, one for each pair of blocks; its
upper levels hold the pair and have no error budget, and what hangs below one
node there is a bucket. Spark deals the buckets; in a bucket, pairs of trie
nodes are walked together from the top bit on, differing bits are added up,
and a pair of nodes is left once it exceeds the budget or once all below it is
known to be connected. A bucket reports a spanning star for each component, never
all its pairs, and buckets of more than ``max_bucket`` members are cut into parts
of which every two meet in a task, so no task holds more than about twice that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from codonlake.llm.components import connected_components
from codonlake.session import stored

SEED = 42
SHINGLE = 4
BUDGET = 4
BLOCKS = (11, 11, 11, 11, 10, 10)
MAX_BUCKET = 1 << 17
_AT_ONCE = 1 << 16
_LEAF = 128
_PAIRS_AT_ONCE = 1 << 21
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(data: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as a signed 64-bit integer; 0 for a text without words."""
    words = data.translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    ends = ends[-n:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        digests = b"".join(
            [xxhash.xxh64_digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE])]
        )
        ones += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t.encode()) if t else 0 for t in texts], dtype="int64")


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fp``; a null text counts as empty and has fingerprint 0."""
    return df.withColumn("fp", _fingerprint(F.col(text)))


def links(points: DataFrame, budget: int = BUDGET, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``(a, b)``: links that connect all ``fp`` within ``budget`` bits of each other.

    ``points`` holds distinct fingerprints. Links are enough to find the
    components, no more. Budgets of one to four bits are supported.
    """
    if not 0 <= budget <= 4:
        raise ValueError("budget must be 0 to 4")
    masks, at = [], 64
    for size in BLOCKS:
        at -= size
        masks.append(((1 << size) - 1) << at)
    pairs = [_signed(x | y) for x, y in combinations(masks, 2)]
    tries = F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), F.lit(m).alias("mask")) for t, m in enumerate(pairs)]))
    rows = points.select("fp", tries.alias("x")).select("fp", "x.trie", F.col("fp").bitwiseAND(F.col("x.mask")).alias("node"))
    hot = rows.groupBy("trie", "node").count().filter(F.col("count") > max_bucket)
    hot = stored(hot.select("trie", "node", F.ceil(F.col("count") / max_bucket).cast("int").alias("parts")), "hot-nodes")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    dealt = rows.join(hot, ["trie", "node"], "left").select(
        "fp", "trie", "node", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other")
    )
    dealt = dealt.select("trie", "node", F.least("own", "other").alias("part"), F.greatest("own", "other").alias("with"), "fp")
    keys = ["trie", "node", "part", "with"]
    sorted_rows = dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return sorted_rows.mapInPandas(lambda it: _bucket_links(it, budget), "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    A component is named by its smallest doc_id. Rows without words share
    fingerprint zero and are linked like any other; a null doc_id never names
    a component unless all its members are null. Repeated rows are repeated.
    """
    prints = stored(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(links(points.select("fp")))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(df: DataFrame) -> DataFrame:
    """The document of each component whose doc_id names it; columns as they are.

    Rows that repeat a doc_id are one document and stay once. Components of
    null ids only keep one row. The ids kept are joined by sorting at every size,
    so that nothing that grows with the documents is broadcast.
    """
    found = near_duplicates(df).filter(F.col("component_id").eqNullSafe(F.col("doc_id")))
    kept = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")), "kept-documents")
    once, more = kept.filter("n = 1").select("doc_id"), kept.filter("n > 1").select("doc_id")

    def among(ids: DataFrame) -> DataFrame:
        named = ids.withColumnRenamed("doc_id", "__kept_id").hint("merge")
        return df.join(named, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")

    if more.isEmpty():
        return among(once)
    return among(once).unionByName(among(more).dropDuplicates(["doc_id"]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucket_links(batches: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    keys, left = ["trie", "node", "part", "with"], None
    for batch in batches:
        rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
        new = np.zeros(len(rows), bool)
        for key in keys:
            values = rows[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        left = rows.iloc[last:]
        yield _star_links(rows["fp"].to_numpy()[:last], new[:last], budget)
    if left is not None:
        new = np.zeros(len(left), bool)
        yield _star_links(left["fp"].to_numpy(), new, budget)


def _star_links(fp: np.ndarray, new: np.ndarray, budget: int) -> pd.DataFrame:
    """Links of the smallest member of each component in a bucket to the others; ``new`` marks where buckets begin."""
    new = new.copy()
    new[:1] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(fp))
    many = ends - starts > 1
    inside = np.repeat(many, ends - starts)
    sizes = (ends - starts)[many]
    fp, ends = fp[inside], np.cumsum(sizes)
    label = joined_labels(fp, ends - sizes, ends, budget)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[label[moved]], "b": fp[moved]})


def joined_labels(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> np.ndarray:
    """For every fingerprint the first position of its component, components being sought within each range.

    Walks pairs of nodes of the binary tries of all ranges at once. Each range is
    rising as unsigned integers once the sign bit is turned, so a node is a range.
    """
    bits = fp.astype(np.int64).view(np.uint64)
    label = np.arange(len(bits))
    bucket = np.repeat(np.arange(len(starts)), ends - starts)
    for turn in range(0, 64, 8):  # neighbours in turned orders first: they join dense buckets cheaply
        turned = (bits << np.uint64(turn)) | (bits >> np.uint64((64 - turn) % 64)) if turn else bits
        order = np.lexsort((turned, bucket))
        a, b = order[:-1], order[1:]
        near = (bucket[a] == bucket[b]) & (np.bitwise_count(bits[a] ^ bits[b]) <= budget)
        label = _merge(label, a[near], b[near])
    order = np.lexsort((bits, bucket))
    bits, label = bits[order], _renamed(label, order)
    zero = np.zeros(len(starts), np.int64)
    stack = [(63, np.array([starts, ends, starts, ends, zero], dtype=np.int64))]
    while stack:
        level, nodes = stack.pop()
        nodes = _open(nodes, label)
        pairs = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        small = (pairs <= _LEAF) | (level < 0)
        label = _verified(nodes[:, small], bits, label, budget)
        nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        ones = np.concatenate([[0], np.cumsum((bits >> np.uint64(level)) & np.uint64(1))]).astype(np.int64)
        below = _children(nodes, ones, budget)
        step = 1 << 16
        stack += [(level - 1, below[:, at : at + step]) for at in range(0, below.shape[1], step)]
    out = np.empty_like(label)
    out[order] = label  # by position in sorted order
    return _first_positions(out)


def _children(nodes: np.ndarray, ones: np.ndarray, budget: int) -> np.ndarray:
    lo1, hi1, lo2, hi2, diff = nodes
    cut1, cut2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
    same = lo1 == lo2
    out = np.concatenate(
        [
            np.array([lo1, cut1, lo2, cut2, diff]),
            np.array([cut1, hi1, cut2, hi2, diff]),
            np.array([lo1, cut1, cut2, hi2, diff + 1]),
            np.array([cut1, hi1, lo2, cut2, diff + 1])[:, ~same],
        ],
        axis=1,
    )
    alive = (out[1] > out[0]) & (out[3] > out[2]) & (out[4] <= budget)
    return out[:, alive & ~((out[0] == out[2]) & (out[1] - out[0] < 2))]


def _open(nodes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Pairs of nodes with more than one component below them."""
    change = np.concatenate([[0, 0], np.cumsum(label[1:] != label[:-1])])[: len(label) + 1]
    one = (change[nodes[1]] == change[nodes[0] + 1]) & (change[nodes[3]] == change[nodes[2] + 1])
    return nodes[:, ~(one & (label[nodes[0]] == label[nodes[2]]))] if nodes.shape[1] else nodes


def _verified(nodes: np.ndarray, bits: np.ndarray, label: np.ndarray, budget: int) -> np.ndarray:
    counts = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS_AT_ONCE, "right")))
        lo1, hi1, lo2, hi2, _ = nodes[:, at:upto]
        n = counts[at:upto]
        which = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (hi2 - lo2)[which]
        a, b = lo1[which] + inner // width, lo2[which] + inner % width
        near = (label[a] != label[b]) & (np.bitwise_count(bits[a] ^ bits[b]) <= budget)
        label = _merge(label, a[near], b[near])
        at = upto
    return label


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def _renamed(label: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The same components, named by the smallest position after the rows are put into another order."""
    return _first_positions(label[order])


def _first_positions(names: np.ndarray) -> np.ndarray:
    _, first, inverse = np.unique(names, return_index=True, return_inverse=True)
    return first[inverse]
