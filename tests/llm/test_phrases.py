"""Phrase collocations against brute force."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from codonlake.llm import phrases

SCHEMA = "doc_id long, lang string, text string, phrase string, n long, a long"
LOWER = str.maketrans(phrases._UPPER, phrases._LOWER)


def expected(rows, least, top):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(len(words)):
                for m in range(1, 6):
                    if k + m <= len(words):
                        counts[lang or "und"][tuple(words[k : k + m])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = set()
        for p, c in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * c >= 100 * f[p[i:j]]:
                        inside.add(p[i:j])
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), f[p[: cut[1]]], f[p[cut[1] :]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "of", "The", "and", "new", "york", "times", "é", "ß\x85x", "x\x00", "a#b", "w1", "w2", "w3", "w4"]
    rows = []
    for _ in range(300):
        out = []
        for _ in range(rng.randrange(0, 40)):
            out.append(rng.choice([rng.choice(words), "new york times", "in the hot pair", f"rare{rng.randrange(999)}"]))
            out.append(rng.choice([" ", " ", " ", "  \t", ", ", ".\n", "\x0b", " . "]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(out)))
    return rows + [("en", None), ("en", ""), (None, " ., "), ("fr", "no one"), ("en", "hot pair " * 3000), ("de", "y" * 3000 + " zz ")] * 2


def frame(spark, rows):
    return spark.createDataFrame([(k, lang, text, "clash", 1, 2) for k, (lang, text) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("dictionary", [phrases.DICTIONARY, 4])
def test_against_brute_force(spark, dictionary):
    """With a dictionary of four words all others go by hash."""
    rows = texts(dictionary)
    got = phrases.collocations(frame(spark, rows), least=8, top=40, dictionary=dictionary)
    want = expected(rows, 8, 40)
    assert {r[0] for r in want} == {"en", "de", "und"} and max(r[1] for r in want) == 40
    assert sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    df = frame(spark, [("en", "a b c"), (None, None)])
    assert phrases.collocations(df).collect() == [] and phrases.collocations(df.limit(0)).collect() == []


def test_three_way_partitions_count_prefixes():
    rng = np.random.default_rng(3)
    grid = rng.integers(1, 5, (4000, 5))
    grid[np.arange(5) >= rng.integers(2, 6, 4000)[:, None]] = 0
    weight = rng.integers(1, 4, 4000)
    counts = collections.Counter()
    for row, w in zip(grid.tolist(), weight.tolist()):
        for d in range(2, 6):
            if row[d - 1]:
                counts[tuple(row[:d])] += w
    closed = np.zeros(4000, np.int64)
    first, depth, total = phrases.three_way_counts(grid, weight, closed, 50)
    got = {tuple(grid[r, :d].tolist()): t for r, d, t in zip(first.tolist(), depth.tolist(), total.tolist())}
    assert len(got) == len(first) and got == {p: c for p, c in counts.items() if c >= 50}
    open_ones = np.where(grid[:, 0] == 1, 5, 0)
    first, depth, total = phrases.three_way_counts(grid, weight, open_ones, 50)
    got = {tuple(grid[r, :d].tolist()): t for r, d, t in zip(first.tolist(), depth.tolist(), total.tolist())}
    assert got == {p: c for p, c in counts.items() if c >= 50 or p[0] == 1}


def test_scores_beyond_64_bits(spark):
    big = spark.sql("SELECT 900000000000 a, 90000000000000 n, 7000000000000 l, 5000000000001 r")
    score = big.selectExpr("(1000 * CAST(a AS decimal(17,0)) * CAST(n AS decimal(17,0))) div (CAST(l AS decimal(17,0)) * CAST(r AS decimal(17,0))) AS s")
    assert score.first()["s"] == 1000 * 900000000000 * 90000000000000 // (7000000000000 * 5000000000001)
