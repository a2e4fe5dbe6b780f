"""Spelling variants against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pandas as pd

from codonlake.llm import bloom, spelling

SCHEMA = "doc_id long, text string, word string, n long"
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def vocabulary(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def expected(words):
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near))
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, *out[w], words.get(forms[w]))
    return out


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = []
    for k in range(400):
        words = []
        for _ in range(rng.randrange(0, 40)):
            w = base[min(int(rng.expovariate(0.1)), 59)]
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), w[at] + rng.choice(letters)]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((k, " ".join(words)))
    long = "y" * 3000
    odd = [None, "", " 12 ..", "÷×÷×÷ " * 4, long, long, long[:-1] + "z", long[:-1] + "z " + long[:-1] + "z", long, "Éclair éclair ÉCLAIR éclair éclair"]
    return rows + [(400 + k, t) for k, t in enumerate(odd)] + [(None, "nullid nullid nullid nullie"), (7, "nullie nullie nullie"), (7, "nullie nullie nullie")]


def as_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_against_brute_force(spark):
    rows = texts(1)
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = spelling.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = expected(vocabulary(rows))
    assert len(want) > 300 and any(v[0] for v in want.values()) and any(v[1] not in (k, v[0]) for k, v in want.items())
    found = got.collect()
    assert len(found) == len(want) and as_rows(got) == want


def test_filters_in_segments_and_passes(spark):
    """Small segments and passes change nothing."""
    words = vocabulary(texts(2))
    df = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    got = sorted(map(tuple, spelling.near_words(df, segment=16, pass_bytes=1500).collect()))
    assert got == sorted((a, b) for a in words for b in words if one_apart(a, b))


def test_filter_is_small_and_true():
    words = pd.Series([f"{a}{b}{c}xyz" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"])
    h = spelling.word_hashes(words).view("uint64")
    segments, passes = spelling._passes([(6, 1000)], 1 << 20, 1 << 20)
    blocks = passes[0][6, 0]
    at, mask = bloom.block_and_mask(h, blocks)
    bits = pd.Series(mask).groupby(at.astype("int64")).agg(lambda m: np.bitwise_or.reduce(m.to_numpy()))
    table = np.zeros(blocks, "uint64")
    table[bits.index] = bits.to_numpy("uint64")
    filters = spelling.Filters(segments, {(6, 0): table})
    others = spelling.word_hashes(pd.Series([f"k{k:05d}".translate(str.maketrans("0123456789", "klmnopqrst")) for k in range(20000)])).view("uint64")
    assert filters.have(6, h).all() and filters.have(6, others).mean() < 0.02


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "few words here", "", 1)], SCHEMA)).collect() == []
