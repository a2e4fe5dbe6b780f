"""Exact top-k search of binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments of about log2 n bits for n distinct codes, each
with an index from its value to the codes that have it, so that a value has few codes
at every size. Of P segments, if two codes are within ``P * (r + 1) - 1`` bits, some segment is
within ``r`` bits. So a round probes all values at distance ``r`` of each query
segment, verifies whole distances, and a query is done once its k-th verified
distance is within what the rounds so far have covered; otherwise ``r`` grows. A
code found in a later round counts only if it is no further than the k-th one known
by then. A pair of codes is reported in one round by one segment only: the first
of those nearest. Copies of a code are one entry with its k smallest ids,
more of them can't be among k answers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codonlake.session import stored

BITS = 64
SALTS = 64
MOST_BROADCAST = 1 << 17


def binary_code(vector: Column) -> Column:
    """One bit for each of 64 dimensions: set if positive. Further dimensions are added to those 64 before. Null for null."""
    zero = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.lit(0.0))
    folded = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vector) / BITS).cast("int") - 1, F.lit(0))),
        zero,
        lambda sums, c: F.transform(
            sums, lambda s, i: s + F.coalesce(F.nanvl(F.get(vector, c * BITS + i).cast("double"), F.lit(0.0)), F.lit(0.0))
        ),
    )
    bits = F.transform(folded, lambda s, i: F.when(s > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(vector.isNotNull(), code)


def _first_ids(codes: DataFrame, k: int) -> DataFrame:
    """``(code, id, place)``: the k smallest ids of each code, in parts first so that no code is one task's."""
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = W.partitionBy("code", "salt").orderBy("id")
    some = salted.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= k)
    whole = W.partitionBy("code").orderBy("id")
    return some.select("code", "id", F.row_number().over(whole).alias("place")).filter(F.col("place") <= k)


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments for ``n`` distinct codes: 64 over log2 n of them, 2 to 8, of even widths but for one bit."""
    parts = min(8, max(2, round(BITS / math.log2(max(n, 2)))))
    ends = [BITS * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _segment(code: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(code, at[0]).bitwiseAND((1 << at[1]) - 1)


def _flips(masks: DataFrame, width: int) -> DataFrame:
    """``(mask, top)`` of one more bit than ``masks``: a bit above the highest is set."""
    higher = masks.filter(F.col("top") < width - 1).select("mask", F.explode(F.sequence(F.col("top") + 1, F.lit(width - 1))).alias("top"))
    return higher.select(F.col("mask").bitwiseOR(F.expr("shiftleft(1L, top)")).alias("mask"), "top")


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, neighbor_id, distance)``: the k nearest of ``codes (id, code)`` to each of ``queries (id, code)``.

    Ties go to the smaller id. Rows with a null id or code take no part; repeated
    rows are answers of their own. With fewer than k rows all are answers, with none there are none.
    """
    codes = codes.filter("id IS NOT NULL AND code IS NOT NULL")
    members = stored(_first_ids(codes, k), "code-members")
    points = stored(members.groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct-codes")
    cut = segments(points.count())
    parts, widest = len(cut), max(w for _, w in cut)

    def in_parts(code: str) -> Column:
        return F.posexplode(F.array(*[_segment(F.col(code), at) for at in cut])).alias("part", "sub")

    index = stored(points.select("code", "first", "n", in_parts("code")), "code-index")
    wanted = queries.filter("id IS NOT NULL AND code IS NOT NULL")
    active = stored(wanted.select(F.col("code").alias("query"), F.lit(BITS).alias("bound")).distinct(), "query-codes")
    masks = codes.sparkSession.range(1).select(F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("top"))
    width = F.element_at(F.array(*[F.lit(w) for _, w in cut]), F.col("part") + 1)
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
    best = done = None
    for r in range(widest + 1):
        if r:
            masks = stored(_flips(masks, widest), f"flips-of-{r}")
        flips = F.broadcast(masks) if math.comb(widest, r) <= MOST_BROADCAST else masks
        probes = (
            active.select("query", "bound", in_parts("query"))
            .join(flips, F.col("mask") < F.call_function("shiftleft", F.lit(1).cast("long"), width))
            .select("query", "bound", "part", F.col("sub").bitwiseXOR(F.col("mask")).alias("sub"))
        )
        apart = lambda j: F.bit_count(_segment(F.col("query"), cut[j]).bitwiseXOR(_segment(F.col("code"), cut[j])))
        once = F.lit(True)
        for j in range(parts):
            once = once & F.when(F.col("part") == j, True).when(F.col("part") > j, apart(j) > r).otherwise(apart(j) >= r)
        found = probes.join(index, ["part", "sub"]).filter(once & (distance <= F.col("bound")))
        new = found.select("query", "code", "first", "n", distance.alias("distance"))
        if best is not None:
            new = new.unionByName(best.join(active, "query", "left_semi"))
        near = W.partitionBy("query").orderBy("distance", "first")
        best = new.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k).drop("place")
        best = stored(best, f"codes-within-{r}")
        covered = parts * (r + 1) - 1
        known = best.groupBy("query").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("distance") <= covered, F.col("n"))).alias("sure"), F.max("distance").alias("last")
        )
        ready = known.filter(F.col("sure") >= k).select("query") if r < widest else active.select("query")
        answers = best.join(ready, "query", "left_semi")
        done = answers if done is None else done.unionByName(answers)
        bound = F.when(F.col("n") >= k, F.col("last")).otherwise(BITS)
        left = active.select("query").join(ready, "query", "left_anti").join(known, "query", "left")
        active = stored(left.select("query", F.coalesce(bound, F.lit(BITS)).alias("bound")), f"queries-after-{r}")
        if active.isEmpty():
            break
    ranked = done.select("query", "code", "distance").join(members.select("code", "id"), "code")
    place = W.partitionBy("query").orderBy("distance", "id")
    top = ranked.select("query", "id", "distance", F.row_number().over(place).alias("rank")).filter(F.col("rank") <= k)
    asked = wanted.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return asked.join(top, "query").select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance")


def nearest_vectors(df: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """The k nearest rows of ``(vec_id, embedding)`` by sign code, for every row whose id is divisible by ``every``.

    Rows with a null id or vector take no part; an empty vector has code 0, nulls and NaN in one count as 0.
    An empty table gives an empty one; other columns are not read.
    """
    codes = df.select(F.col("vec_id").alias("id"), binary_code(F.col("embedding")).alias("code"))
    codes = stored(codes, "vector-codes")
    return nearest(codes, codes.filter(F.col("id") % every == 0), k)
