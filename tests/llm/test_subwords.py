"""BPE by speculation and verification against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codonlake.llm import subwords

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, decoded string, n_tokens long"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return subwords.Vocabulary.load(PATH)


def same(library, vocabulary, texts):
    packed = subwords.Encoder(vocabulary).texts(texts)
    for text, got, want in zip(texts, packed, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, np.int32).tolist() == want.ids, text[:80]


@pytest.mark.parametrize(
    "alphabet", ["ab", "abc", "the in", "aeinrst", "!.?-\"'", "é ü ñ ß", "日本語テ", "abcdefghijklmnopqrstuvwxyz   ", "ΑΣσς ǅİ̸́<|>"]
)
def test_random_texts(library, vocabulary, alphabet):
    rng = random.Random(alphabet)
    same(library, vocabulary, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1000)])


def test_every_code_point(library, vocabulary):
    letters = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(library, vocabulary, ["x".join(map(chr, letters[k : k + 64])) for k in range(0, len(letters), 64)])


def test_odd_texts(library, vocabulary):
    odd = ["", " ", "it's WE'LL 12ab_3", "a<|endoftext|>b <|startoftext|≯", "<|endoftext|", "\x1c\x85\xa0x　y", "y" * 20000, "ab" * 9000, "\x00z"]
    same(library, vocabulary, odd)


def test_proposals_fail_and_are_merged(vocabulary):
    words = [w.encode() for w in ("unaffordableness", "thethe", "aaaaaaa", "zzyzzx", "informationally", "reenactments", "oooooooh")]
    rng = random.Random(4)
    words += ["".join(rng.choice("aeinrstol") for _ in range(12)).encode() for _ in range(500)]
    exact = [vocabulary.merged(w) for w in words]
    assert vocabulary.encode_words(words) == exact
    wrong = [w for w, e in zip(words, exact) if vocabulary.proposed(w) != e]
    assert 0 < len(wrong) < len(words)


def test_pairs(vocabulary):
    """The check says of a pair what merging its bytes says."""
    rng = random.Random(5)
    inner, final = list(vocabulary.inner.items()), list(vocabulary.final.items())
    pairs = [(rng.choice(inner), rng.choice(final)) for _ in range(20000)]
    left, right = (np.array([p[k][1] for p in pairs]) for k in (0, 1))
    want = [vocabulary.merged(a + b) == [x, y] for (a, x), (b, y) in pairs]
    assert vocabulary.stand(left, right).tolist() == want and not all(want)


def test_table(spark, library):
    texts = [None, "", "Hello  World\n" * 3, "naïve café " * 400, "word " * 60000, "Hello  World\n" * 3]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "null id", "", 2)], SCHEMA)
    got = {r["doc_id"]: r for r in subwords.round_trip_digests(df).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        plain = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[k]) == (k, len(ids), digest(" ".join(map(str, ids))), digest(plain))
    assert got[None]["n_tokens"] == 2
    assert subwords.round_trip_digests(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        subwords.encoded(df, ids="n_tokens")


def test_decode(spark, library):
    df = spark.createDataFrame([(0, [5, 600, None, 99999999, -1]), (1, []), (2, None), (3, [49407, 320])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in subwords.with_text(df).collect()}
    assert got == {0: library.decode([5, 600]), 1: "", 2: None, 3: library.decode([49407, 320], skip_special_tokens=False)}
