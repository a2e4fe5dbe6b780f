"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words. A document of a source is due
``target / source words`` copies, the same for all; its whole part is taken for
certain and its fraction is rounded. Rounding is pivotal: two documents with
open fractions trade words, one winning what the other loses, until one fraction is
0 or 1; which way is drawn so that each keeps its expectation. A source's words are
kept in every trade, so its sum misses the target by less than one document.
The trades run in a reduction tree: groups of about ``FANOUT`` documents leave one
open document each, those are grouped again, until one is left for each source.
Draws are hashes of ids, so reruns agree. Only built-in functions run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codonlake.llm.words import word_count
from codonlake.session import stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
FANOUT = 128
SEED = 20
_OPEN = "struct<doc_id:bigint,size:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,extra:int>>"


def source_targets(rows: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` of each source of ``rows (source, size)``.

    Sources in code-point order, null last, weigh 5, 2, 1 and so on. A target
    is weight times a common level, at most three times the source's size; the
    level is the one at which all targets add up to all sizes. A source without words
    has target 0. Runs over one row for each source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))))
    weighed = sources.select("source", "source_size", weight.alias("w")).withColumn(
        "cap", F.col("source_size") * float(MOST_COPIES)
    )
    everything = W.partitionBy(F.lit(1))
    full = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    levels = weighed.select(
        "*",
        (F.col("cap") / F.col("w")).alias("reach"),
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("cap").over(full) - F.col("cap")).alias("below"),
        (F.sum("w").over(everything) - F.sum("w").over(full) + F.col("w")).alias("open_weight"),
    ).withColumn("level", (F.col("total") - F.col("below")) / F.col("open_weight"))
    fits = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "level"))).over(everything)
    level = F.coalesce(fits["level"], F.max("reach").over(everything))
    return levels.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def _trade(level: int):
    """Merge step of the fold over a group: the document still open trades with the next one."""

    def step(a: Column, it: Column) -> Column:
        c = a["open"]
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(level), c["doc_id"], it["doc_id"]), 11) / F.lit(2.0**53)
        p, u, q, v = c["p"], c["size"], it["p"], it["size"]
        up, down = F.least((1 - p) * u, q * v), F.least(p * u, (1 - q) * v)
        won = draw * (up + down) < down

        def now(done: Column, extra: int, left: Column, share: Column) -> Column:
            settled = F.struct(done["doc_id"].alias("doc_id"), done["size"].alias("size"), F.lit(extra).alias("extra"))
            still = F.struct(left["doc_id"].alias("doc_id"), left["size"].alias("size"), share.alias("p"))
            return F.struct(still.alias("open"), F.concat(a["done"], F.array(settled)).alias("done"))

        traded = (
            F.when(won & ((1 - p) * u <= q * v), now(c, 1, it, q - (1 - p) * u / v))
            .when(won, now(it, 0, c, p + q * v / u))
            .when(p * u <= (1 - q) * v, now(c, 0, it, q + p * u / v))
            .otherwise(now(it, 1, c, p - (1 - q) * v / u))
        )
        first = F.struct(
            F.struct(it["doc_id"].alias("doc_id"), it["size"].alias("size"), it["p"].alias("p")).alias("open"),
            a["done"].alias("done"),
        )
        return F.when(c.isNull(), first).otherwise(traded)

    return step


def rounded(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(source, doc_id, size, extra)``: each fraction ``p`` of ``rows (source, doc_id, size, p)`` becomes 0 or 1.

    Sizes are positive. Within a source the sum of size times extra stays at
    that of size times p, but for less than one document.
    """
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    counts, decided, level = stored(counts, "mix-counts"), None, 0
    most = counts.agg(F.max("n")).first()[0] or 0
    while most > 0:
        width = fanout ** (level + 1)
        groups = F.greatest(F.lit(1), F.ceil(F.col("n") / width)).cast("long")
        spot = F.pmod(F.xxhash64(F.lit(SEED), F.lit(-1 - level), "doc_id"), groups)
        item = F.struct(F.xxhash64(F.lit(SEED), "doc_id").alias("at"), "doc_id", "size", "p")
        named = counts.withColumnRenamed("source", "counted")
        grouped = (
            rows.join(named, F.col("source").eqNullSafe(F.col("counted")))
            .withColumn("spot", spot)
            .groupBy("source", "spot")
            .agg(F.sort_array(F.collect_list(item)).alias("items"))
        )
        start = F.struct(F.lit(None).cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))
        folded = stored(
            grouped.select("source", F.aggregate("items", start, _trade(level)).alias("r")), f"mix-level-{level}"
        )
        done = folded.select("source", F.explode("r.done").alias("d")).select("source", "d.*")
        decided = done if decided is None else decided.union(done)
        rows = folded.select("source", "r.open.*")
        if math.ceil(most / width) <= 1:
            draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(level + 1), "doc_id"), 11) / F.lit(2.0**53)
            return decided.union(rows.select("source", "doc_id", "size", (draw < F.col("p")).cast("int")))
        level += 1
    return rows.select("source", "doc_id", "size", F.lit(0).alias("extra"))


def mixture(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row.

    Null texts have size 0 and are taken 0 times; a null source is a source.
    An empty table gives no rows. Rows that repeat a doc_id are documents of
    their own.
    """
    sized = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )
    sized = stored(sized, "mix-sizes")
    targets = stored(
        source_targets(sized).select(
            F.col("source").alias("named"),
            "source_size",
            "target",
            F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("due"),
        ),
        "mix-targets",
    )
    whole = F.floor("due").cast("long")
    due = sized.join(targets, F.col("source").eqNullSafe(F.col("named")))
    open_ones = (F.col("size") > 0) & (F.col("due") > whole)
    rows = due.filter(open_ones).select("source", "doc_id", "size", (F.col("due") - whole).alias("p"))
    settled = due.filter(~open_ones).select("source", "doc_id", "size", F.lit(0).alias("extra"))
    extras = rounded(rows).unionByName(settled)
    return extras.join(targets, F.col("source").eqNullSafe(F.col("named"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (whole + F.col("extra"))).alias("taken"),
        F.when(F.col("size") > 0, whole + F.col("extra")).otherwise(0).alias("copies"),
    )


def mixed(df: DataFrame) -> DataFrame:
    """Every row as often as the mix takes it, columns as they are.

    Rows that share a doc_id are taken equally often, as often as the one the
    mix takes most. Copies are joined by sorting at every size; they grow with the
    documents and are never broadcast.
    """
    copies = mixture(df).groupBy("doc_id").agg(F.max("copies").alias("__copies")).filter(F.col("__copies") > 0)
    copies = stored(copies.withColumnRenamed("doc_id", "__doc_id"), "mix-copies")
    taken = df.join(copies.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__doc_id")))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")
    return taken.select(*[F.col(f"`{c}`") for c in df.columns], each).drop("__copy")
