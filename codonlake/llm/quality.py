"""Quality rules: simple counts, and a hashed n-gram log-likelihood ratio of every document.

Words and pairs of neighbouring words fall into ``buckets`` by hash. Two multinomials are
counted over all documents: one over the trusted target (documents that the
strict rules below let pass), one over the raw corpus. A document's score is the
mean, over its words and pairs, of the log ratio of the two. The cut comes from the
scores of the trusted target. Their variance has two parts: between documents, whatever
their length, and of the mean over n words and pairs, which falls with n. A document fails if its
score favours the corpus (is negative) and lies further below the mean of the trusted ones than
``DEVIATIONS`` standard deviations at its length.
Only built-in functions run; the table of log ratios has ``buckets`` entries whatever
the corpus. Texts are read twice, nothing but the counts of the buckets is shuffled,
and scored rows are stored once, as the cut is known only when all have a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codonlake.llm.words import bound, words
from codonlake.operators.binding import compute_once
from codonlake.session import stored

BUCKETS = 10_000
#: Of 4 to 12 the one with the fewest errors on the labelled rows of sf0.01, sf0.1 and check_s.
DEVIATIONS = 6.0
MIN_WORDS = 50
REPEAT_PERCENT = 50
TRUSTED_SYMBOL_PERCENT = 1
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(in_order: Column) -> Column:
    """Words covered by windows of three that occur twice or more; ``in_order`` holds (hash, place) sorted."""
    twice = F.filter(
        in_order,
        lambda x, j: (x["hash"] == F.get(in_order, j - 1)["hash"]) | (x["hash"] == F.get(in_order, j + 1)["hash"]),
    )
    places = F.array_sort(F.transform(twice, lambda x: x["place"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        places,
        start,
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n")),
    )["n"]
    return F.when(F.size(in_order) == 0, F.lit(0)).otherwise(covered)


def _neighbours(array: str) -> tuple[Column, Column]:
    """An array without its last and without its first element."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.slice(array, 1, n), F.slice(array, 2, n)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, _WHITE, "")).cast("long")


def _trusted(n_words: Column, n_symbols: Column, word_chars: Column, n_dup_lines: Column) -> Column:
    return (n_words >= MIN_WORDS) & (100 * n_symbols <= TRUSTED_SYMBOL_PERCENT * word_chars) & (n_dup_lines == 0)


def log_ratios(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: ``llr``, the log ratio of target to raw frequency of each bucket, each count raised by one.

    The trusted target is every document of at least ``MIN_WORDS`` words without
    repeated lines and with few symbols. Without any, all ratios are 0.
    """
    given = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = compute_once(given, w=words(F.col("t")))
    trusted = _trusted(F.size("w"), _symbols(F.col("t")), _word_chars(F.col("t")), _dup_lines(F.col("t")))
    pairs = compute_once(split, trusted=trusted.cast("long")).select(
        "trusted", F.explode(F.arrays_zip(F.col("w").alias("a"), _neighbours("w")[1].alias("b"))).alias("p")
    )
    hashed = pairs.select("trusted", F.xxhash64("p.a").alias("a"), F.when(F.col("p.b").isNotNull(), F.xxhash64("p.b")).alias("b"))
    pair = F.when(F.col("b").isNotNull(), F.xxhash64("a", "b"))
    grams = hashed.select("trusted", F.explode(F.array("a", pair)).alias("hash")).filter("hash IS NOT NULL")
    gram = F.pmod("hash", F.lit(buckets)).cast("int").alias("gram")
    counts = grams.groupBy(gram).agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    grid = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("gram"))
    cells = grid.join(counts, "gram", "left").select(
        "gram", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    row = cells.agg(
        F.sort_array(F.collect_list(F.struct("gram", "raw", "target"))).alias("cells"),
        F.sum("raw").alias("all_raw"),
        F.sum("target").alias("all_target"),
    )
    ratio = lambda c: F.when(
        F.col("all_target") > 0,
        F.log((c["target"] + 1) / (F.col("all_target") + buckets)) - F.log((c["raw"] + 1) / (F.col("all_raw") + buckets)),
    ).otherwise(0.0)
    return row.select(F.transform("cells", ratio).alias("llr"))


def scored(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Add the struct ``__quality``: the counts, ``base_failed`` and ``score``.

    Every document is scored; one without words scores 0 (and fails
    the base rules). A null text has no words. Windows of three words are compared by
    a 64-bit hash within their document. An empty table stays empty.
    """
    given = [F.col(f"`{c}`") for c in df.columns]
    llr = log_ratios(df, text, buckets).scalar()
    one = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    two = compute_once(one, __h=F.transform(words(F.col("__text")), lambda w: F.xxhash64(w)))
    three = compute_once(two, __pairs=F.zip_with(*_neighbours("__h"), lambda a, b: F.xxhash64(a, b)))
    four = compute_once(three, __threes=F.zip_with(*_neighbours("__pairs"), lambda a, b: F.xxhash64(a, b)))
    add = lambda s, g: s + F.get("__llr", F.pmod(g, F.lit(buckets)).cast("int"))
    total = F.aggregate("__pairs", F.aggregate("__h", F.lit(0.0), add), add)
    score = F.coalesce(F.try_divide(total, F.size("__h") + F.size("__pairs")), F.lit(0.0))
    whole = four.select("*", llr.alias("__llr")).select(
        *given, "__text", "__threes", F.size("__h").cast("long").alias("__n"), score.alias("__score")
    )
    places = F.sort_array(F.transform("__threes", lambda x, i: F.struct(x.alias("hash"), i.alias("place"))))
    some = F.size(F.array_distinct("__threes")) < F.size("__threes")
    five = compute_once(
        whole,
        __repeat=F.when(some, bound(places, _repeated_words)).otherwise(0).cast("long"),
        __symbols=_symbols(F.col("__text")),
        __chars=_word_chars(F.col("__text")),
        __dup=_dup_lines(F.col("__text")),
    )
    failed = (F.col("__n") < MIN_WORDS) | (100 * F.col("__repeat") > REPEAT_PERCENT * F.col("__n"))
    verdict = F.struct(
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("__score").alias("score"),
    )
    return five.select(*given, verdict.alias("__quality"))


def judged(rows: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """Add ``kept`` to the struct ``__quality`` of stored rows of ``scored``.

    The squared distances d of trusted scores from their mean are ``between + within / n`` on average over n
    words and pairs. The averages of d and of n d over the trusted documents give both parts; with one
    length only all of it is within. Without trusted documents all scores are 0 and the base rules alone decide.
    """
    q = lambda c: F.col(f"__quality.{c}")
    terms, score = F.greatest(2 * q("n_words") - 1, F.lit(1)).cast("double"), q("score")
    target = rows.filter(~q("base_failed") & _trusted(q("n_words"), q("n_symbols"), q("word_chars"), q("n_dup_lines")))
    mean = target.agg(F.avg(score)).scalar()
    apart = target.select(terms.alias("n"), ((score - mean) ** 2).alias("d"))
    sums = apart.agg(
        F.avg("d").alias("d"), F.avg(F.col("n") * F.col("d")).alias("nd"), F.avg("n").alias("n"), F.avg(1 / F.col("n")).alias("h")
    )
    excess = F.col("n") * F.col("h") - 1  # 0 if all lengths are equal
    between = F.when(excess > 1e-9, F.least(F.greatest((F.col("nd") * F.col("h") - F.col("d")) / excess, F.lit(0.0)), F.col("d"))).otherwise(0.0)
    parts = sums.withColumn("between", between).select(
        F.struct("between", F.greatest(F.col("nd") - F.col("between") * F.col("n"), F.lit(0.0)).alias("within")).alias("v")
    )
    told = rows.select("*", F.coalesce(mean, F.lit(0.0)).alias("__mean"), parts.scalar().alias("__v"))
    spread = F.sqrt(F.coalesce(F.col("__v.between") + F.col("__v.within") / terms, F.lit(0.0)))
    kept = ~q("base_failed") & ((score >= 0) | (score - F.col("__mean") >= F.lit(-1e-9) - deviations * spread))
    return told.withColumn("__quality", F.col("__quality").withField("kept", kept)).drop("__mean", "__v")


def quality_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``score`` of every row."""
    rows = scored(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "__quality")
    found = judged(stored(rows, "quality-scores"))
    q = lambda c: F.col(f"__quality.{c}")
    return found.select("doc_id", *[q(c) for c in _COUNTS], q("base_failed"), q("kept"), q("score"))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that the rules keep, columns as they are."""
    passed = stored(scored(df, text).filter("NOT __quality.base_failed"), "quality-passed")
    return judged(passed).filter("__quality.kept").drop("__quality")
