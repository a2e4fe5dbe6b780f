"""Secret scan: three fixed patterns, and a battery of randomness tests under false-discovery control.

Every run of 20 or more characters of the base64 alphabets is a candidate. Its
encoding is inferred from its characters, and its symbols become numbers. A
candidate must look random: chi-squared over eight classes of symbols, runs
about the middle, and lag-one serial correlation are added up, and the sum must not
be rejected at ``ALPHA``. It must also be unlike ordinary text: a word's chi-squared
grows with its length, so the p-value of the null "ordinary text" comes from a
noncentral chi-squared with noncentrality in proportion to length. Those p-values
go through Benjamini-Hochberg within each encoding and doubling of length, on a
grid of powers of two. Only built-in functions run, and what is gathered from the
corpus is a table of encodings by length classes by grid steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codonlake.llm.words import bound, sums_before
from codonlake.operators.binding import compute_once

ALPHA = 0.001
FALSE_DISCOVERIES = 0.01
MIN_LENGTH = 20
CLASSES = 8
GRID = 60
#: Least excess of chi-squared a symbol that ordinary text has, by encoding.
EXCESS = {"hex": 0.5, "base32": 0.6, "base64": 0.8}
MASK = "[SECRET]"

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
_SYMBOLS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _spans(text: Column, pattern: str, kind: str, value: Column | None = None) -> Column:
    """``(start, rank, end, kind, value)`` of leftmost non-overlapping matches, in code points, ends exclusive."""
    rank = KINDS.index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if value is None else value
    gaps = F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        widths = lambda g: F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long"))
        with_starts = lambda g: bound(
            sums_before(widths(g)),
            lambda before: F.transform(
                F.arrays_zip(m.alias("m"), g.alias("g"), before.alias("b"), values.alias("v")),
                lambda x: F.struct(
                    (x["b"] + F.length(x["g"])).alias("start"),
                    F.lit(rank).alias("rank"),
                    (x["b"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                    F.lit(kind).alias("kind"),
                    x["v"].alias("value"),
                ),
            ),
        )
        return F.filter(bound(gaps, with_starts), lambda s: s["value"].isNotNull())

    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>")
    return bound(matches, lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def _upper_tail(z: Column) -> Column:
    """Normal probability above ``z``, by a logistic approximation within 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _battery(token: Column) -> Column:
    """Encoding, length and the two p-values of a candidate."""
    body = F.rtrim(token, F.lit("="))
    kind = (
        F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )
    plain = lambda k, b: F.when(k == "hex", F.lower(b)).otherwise(F.translate(b, "-_", "+/"))
    alphabet = lambda k: F.when(k == "hex", _SYMBOLS["hex"]).when(k == "base32", _SYMBOLS["base32"]).otherwise(
        _SYMBOLS["base64"]
    )
    size = lambda k: F.when(k == "hex", 16).when(k == "base32", 32).otherwise(64)
    excess = lambda k: F.when(k == "hex", EXCESS["hex"]).when(k == "base32", EXCESS["base32"]).otherwise(
        EXCESS["base64"]
    )

    def add(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def tests(k: Column, v: Column) -> Column:
        n, m = F.size(v).cast("double"), size(k)
        counts = F.transform(
            F.sequence(F.lit(0), F.lit(CLASSES - 1)),
            lambda c: F.size(F.filter(v, lambda x: F.floor(x * CLASSES / m) == c)).cast("double"),
        )
        chi = add(F.transform(counts, lambda o: (o - n / CLASSES) * (o - n / CLASSES) * CLASSES / n))
        upper = F.size(F.filter(v, lambda x: x >= m / 2)).cast("double")
        both = 2 * upper * (n - upper)
        turns = F.size(F.filter(v, lambda x, i: (i > 0) & ((x >= m / 2) != (F.get(v, i - 1) >= m / 2)))) + 1.0
        spread = F.sqrt(both * (both - n) / (n * n * (n - 1)))
        runs = F.when(both > n, (turns - 1 - both / n) / spread).otherwise(6.0)
        mean = lambda use: bound(add(v) / n, use)
        serial = mean(
            lambda a: F.coalesce(
                F.try_divide(
                    add(F.transform(F.slice(v, 2, F.size(v)), lambda x, i: (x - a) * (F.get(v, i) - a))),
                    add(F.transform(v, lambda x: (x - a) * (x - a))),
                ),
                F.lit(1.0),
            )
        )
        return F.struct(k.alias("encoding"), n.alias("n"), chi.alias("chi"), runs.alias("runs"), ((serial + 1 / n) * F.sqrt(n)).alias("serial"))

    def judged(t: Column) -> Column:
        df, k, n = CLASSES - 1, t["encoding"], t["n"]
        z = (F.cbrt(t["chi"] / df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        high = F.greatest(z, F.lit(0.0))
        total = high * high + t["runs"] * t["runs"] + t["serial"] * t["serial"]
        random = _upper_tail((F.cbrt(total / 3) - (1 - 2 / 27)) / (2 / 27) ** 0.5)
        far = n * excess(k)
        plain_text = 1 - _upper_tail((t["chi"] - (df + far)) / F.sqrt(2 * (df + 2 * far)))
        grid = F.least(F.lit(GRID), F.greatest(F.lit(0), F.floor(-F.log2(F.greatest(plain_text, F.lit(2.0**-GRID))))))
        return F.struct(
            F.concat_ws("-", k, F.floor(F.log2(n)).cast("string")).alias("stratum"),
            random.alias("random"),
            grid.cast("int").alias("step"),
        )

    values = lambda k: F.transform(
        F.split(plain(k, body), ""), lambda c: (F.position(c, alphabet(k)) - 1).cast("double")
    )
    clean = lambda v: F.filter(v, lambda x: x >= 0)  # noqa: E731  padding inside a run has no value
    return bound(kind, lambda k: bound(clean(values(k)), lambda v: bound(tests(k, v), judged)))


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__found``: base spans and the candidates with their p-values."""
    given = df.columns
    one = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__text")
    group = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1))
    long_value = F.transform(group, lambda v: F.when(F.length(v) >= 8, v))
    base = F.concat(_spans(t, ASSIGN, "assign", long_value), _spans(t, ACCESS, "access"), _spans(t, HEX, "hex"))
    runs = _spans(t, rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}", "random")
    two = compute_once(one, __base=base, __runs=runs)
    three = compute_once(two, __tests=F.transform("__runs", lambda x: _battery(x["value"])))
    found = F.struct(F.col("__base").alias("base"), F.arrays_zip(F.col("__runs").alias("run"), F.col("__tests").alias("test")).alias("runs"))
    return three.select(*[F.col(f"`{c}`") for c in given], found.alias("__found"))


def thresholds(scan: DataFrame) -> DataFrame:
    """One row: ``steps``, a map from stratum to the least grid step that keeps false discoveries in bounds."""
    tests = scan.select(F.explode("__found.runs").alias("r")).select("r.test.*")
    counts = tests.groupBy("stratum", "step").agg(
        F.count("*").alias("all"), F.count(F.when(F.col("random") >= ALPHA, 1)).alias("random")
    )
    by_step = counts.groupBy("stratum").agg(
        F.sum("all").alias("m"), F.collect_list(F.struct("step", "random")).alias("steps")
    )
    reached = F.filter(
        F.sequence(F.lit(1), F.lit(GRID)),
        lambda s: bound(
            F.aggregate(
                F.filter("steps", lambda x: x["step"] >= s), F.lit(0).cast("long"), lambda n, x: n + x["random"]
            ),
            lambda n: (n > 0) & (F.col("m") * F.pow(F.lit(2.0), -s) <= FALSE_DISCOVERIES * n),
        ),
    )
    least = by_step.select("stratum", F.array_min(reached).alias("step")).filter("step IS NOT NULL")
    return least.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "step"))).alias("steps"))


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__spans``: all spans by start, then kind; random ones that a base span covers are left out.

    A null text counts as empty. Texts of any length are scanned whole.
    """
    scan = scanned(df, text)
    least = thresholds(scan).scalar()

    def random_of(steps: Column) -> Column:
        hits = F.filter(
            "__found.runs",
            lambda r: (r["test"]["random"] >= ALPHA) & (r["test"]["step"] >= F.try_element_at(steps, r["test"]["stratum"])),
        )
        alone = F.filter(
            F.transform(hits, lambda r: r["run"]),
            lambda s: ~F.exists("__found.base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])),
        )
        return F.sort_array(F.concat("__found.base", alone))

    known = scan.select("*", least.alias("__least"))
    return compute_once(known, __spans=random_of(F.col("__least"))).drop("__found", "__least")


def _listed(spans: Column) -> Column:
    each = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")


def secret_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans of every row."""
    found = with_spans(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    of = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("__spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("__spans")).alias("spans"),
        of("random").alias("n_random"),
    )


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """Every span of a text becomes ``[SECRET]``; spans that overlap become one. A null text stays null."""
    found = with_spans(df, text)
    source = F.col(text)
    empty = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("parts"))
    cut = lambda a, s: F.substring(source, a["end"].cast("int") + 1, (s["start"] - a["end"]).cast("int"))
    pieces = F.aggregate(
        "__spans",
        empty,
        lambda a, s: F.when(
            s["start"] < a["end"],
            F.struct(F.greatest(a["end"], s["end"]).alias("end"), a["parts"].alias("parts")),
        ).otherwise(
            F.struct(s["end"].alias("end"), F.concat(a["parts"], F.array(cut(a, s), F.lit(MASK))).alias("parts"))
        ),
    )
    rest = lambda a: F.concat(F.array_join(a["parts"], ""), source.substr(a["end"].cast("int") + 1, F.length(source)))
    clean = F.when(F.size("__spans") == 0, source).otherwise(bound(pieces, rest))
    columns = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    return found.select(*columns)
