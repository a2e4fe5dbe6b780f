"""Column helpers shared by the operators: words, bound values, running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(numbers: Column, chunk: int = 256) -> Column:
    """For each number of an array of longs the sum of those before it.

    Works in chunks, so that long arrays do not cost their square.
    """

    def running(array: Column, start: Column) -> Column:
        grown = F.aggregate(
            array, F.array(start), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
        )
        return F.slice(grown, 1, F.size(array))

    def add(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)

    def in_chunks(array: Column) -> Column:
        n = F.ceil(F.size(array) / chunk).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.slice(array, c * chunk + 1, F.lit(chunk)))
        return bound(
            parts,
            lambda ps: bound(
                running(F.transform(ps, add), F.lit(0).cast("long")),
                lambda starts: F.flatten(F.transform(ps, lambda p, c: running(p, F.get(starts, c)))),
            ),
        )

    return F.when(F.size(numbers) == 0, numbers).otherwise(bound(numbers, in_chunks))
