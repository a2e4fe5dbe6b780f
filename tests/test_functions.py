import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codonlake import alphabets
from codonlake.functions import (
    c_terminal,
    classes_to_three_di,
    encoder_prompt,
    reverse_complement,
    sequence_entropy,
    shannon_entropy,
    strip_trailing_stop,
    subsequence,
    translate_codons,
)
from codonlake.operators.levels import entropy_from_counts, symbol_counts
from codonlake.operators.labels import confidence_band, encoding_method, predicted_label


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def python_entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) + 0.0 if text else 0.0


@pytest.mark.parametrize(
    "text, bits",
    [("", 0.0), ("AAAA", 0.0), ("ATAT", 1.0), ("ACGT", 2.0), (alphabets.AA_ALPHABET, math.log2(20)), ("ACGTN", math.log2(5))],
)
def test_entropy_values(spark, text, bits):
    assert one(spark, shannon_entropy("s"), s=text) == pytest.approx(bits, abs=1e-10)


def test_entropy_case_and_normalisation(spark):
    assert one(spark, sequence_entropy("s"), s="aAaA") == 0.0
    assert one(spark, shannon_entropy("s"), s="aAaA") == 1.0
    assert one(spark, shannon_entropy("s", 4, normalize=True), s="ATAT") == pytest.approx(0.5)
    assert one(spark, shannon_entropy("s", 1, normalize=True), s="ATAT") == 1.0
    assert one(spark, shannon_entropy("s", normalize=True), s="ATAT") == 1.0


def test_entropy_of_all_kinds_of_symbols(spark):
    for text in ("ACGTACGTTT", "ACGT-acgt**", "AAAA", "é1é1zz", "a b\nc" * 50_000):
        assert one(spark, shannon_entropy("s"), s=text) == pytest.approx(python_entropy(text), abs=1e-12)


def test_chunked_counts_agree(spark, monkeypatch):
    from codonlake.operators import levels

    monkeypatch.setattr(levels, "CHUNK_SYMBOLS", 7)
    rng = random.Random(1)
    texts = {f"s{i}": "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 60))) for i in range(30)}
    seqs = spark.createDataFrame(list(texts.items()), "seq_id string, seq string")
    counts = symbol_counts(seqs)
    got = {(r["seq_id"], r["symbol"]): r["n"] for r in counts.collect()}
    assert got == {(k, c): n for k, t in texts.items() for c, n in Counter(t).items()}
    for r in entropy_from_counts(counts).collect():
        assert r["entropy"] == pytest.approx(python_entropy(texts[r["seq_id"]]), abs=1e-9)


def test_reverse_complement(spark):
    assert one(spark, reverse_complement("s"), s="ACGTNacgt-") == "-acgtNACGT"
    assert one(spark, reverse_complement(reverse_complement("s")), s="ACGGTNN") == "ACGGTNN"


@pytest.mark.parametrize(
    "nt, aa", [("ATGNNNGGGTTT", "MXGF"), ("ATGGCATAG", "MA*"), ("ATGGC", "M"), ("atggca", "MA"), ("", "")]
)
def test_translation(spark, nt, aa):
    assert one(spark, translate_codons("s"), s=nt) == aa


def test_genetic_codes(spark):
    assert one(spark, translate_codons("s", 4), s="TGA") == "W"
    assert one(spark, translate_codons("s", 2), s="AGAATA") == "*M"
    assert sorted(alphabets.stop_codons(11)) == ["TAA", "TAG", "TGA"]
    assert alphabets.genetic_code_table(spark).count() == 64 * len(alphabets.CODE_DIFFERENCES)
    with pytest.raises(ValueError):
        alphabets.genetic_code(7)


def test_tails(spark):
    assert one(spark, c_terminal("s", 10), s="MTRWPEHVDLNYIG**") == "PEHVDLNYIG"
    assert one(spark, c_terminal("s", 10), s="MK*") == "MK"
    assert one(spark, c_terminal("s", 0), s="MKSL*") == "MKSL"
    assert one(spark, strip_trailing_stop(F.lit("MK**"))) == "MK*"


def test_subsequence(spark):
    seq = "AACCGGTTA"
    rc = "TAACCGGTT"
    for start in range(1, 10):
        for end in range(start, 12):
            assert one(spark, subsequence(F.lit(seq), F.lit(start), F.lit(end), F.lit("+"))) == seq[start - 1 : end]
            assert one(spark, subsequence(F.lit(seq), F.lit(start), F.lit(end), F.lit("-"))) == rc[start - 1 : end]
            if end > start + 2:
                break
    with pytest.raises(Exception, match="coordinates"):
        one(spark, subsequence(F.col("s"), F.lit(0), F.lit(3), F.lit("+")), s=seq)
    with pytest.raises(Exception, match="precedes"):
        one(spark, subsequence(F.col("s"), F.lit(5), F.lit(3), F.lit("+")), s=seq)


def test_encoder_text_and_letters(spark):
    assert one(spark, encoder_prompt("s"), s="MUkB") == "<AA2fold> M X K X"
    assert one(spark, classes_to_three_di(F.array(*map(F.lit, [0, 19, 5, 7])), F.lit(3))) == "AYG"


def test_labels(spark):
    assert one(spark, predicted_label(F.lit(0.5))) == 0
    assert [one(spark, confidence_band(F.lit(p))) for p in (0.95, 0.7, 0.5, 0.05)] == ["high", "medium", "low", "high"]
    assert one(spark, encoding_method(F.lit("anything"))) == "prostt5_aa2fold"


def test_entropies_of_a_batch_equal_those_of_single_strings(spark):
    from codonlake.functions.entropy import entropies_of, short_entropy

    texts = ["", "AAAA", "ACGT", "acGTNN*", None, "é\U0001f600é", "MKV" * 50 + "*", "x y\n"]
    one = [math.nan if t is None else -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    assert entropies_of(texts).tolist() == pytest.approx(one, nan_ok=True)
    assert not any(math.copysign(1, x) < 0 for x in entropies_of(["AAAA", ""]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for options in ({}, {"alphabet_size": 4, "normalize": True}):
        rows = df.select(short_entropy("t", **options).alias("a"), sequence_entropy("t", **options).alias("b")).collect()
        assert all((r["a"] is None) == (r["b"] is None) for r in rows)
        assert [r["a"] for r in rows if r["a"] is not None] == pytest.approx([r["b"] for r in rows if r["b"] is not None])
