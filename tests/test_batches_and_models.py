import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codonlake.functions import encoder_prompt
from codonlake.operators import batching, metrics, splits
from codonlake.operators.classifier import OrfClassifier
from codonlake.operators.encoding import constant_encoder, encode_proteins, unencoded
from codonlake.operators.features import FEATURE_NAMES, feature_matrix, incomplete
from codonlake.plans import jobs


def greedy(lengths, budget):
    """Batches of the rule itself: longest first, fill with shortest, oversize alone."""
    left, out = sorted(lengths), []
    while left:
        batch, longest = [], 0
        while left:
            n = left[-1]
            if n > budget:
                if batch:
                    out.append(batch)
                    batch, longest = [], 0
                out.append([left.pop()])
                continue
            if (len(batch) + 1) * max(longest, n) > budget:
                break
            batch.append(left.pop())
            longest = max(longest, n)
        while left and (len(batch) + 1) * max(longest, left[0]) <= budget:
            batch.append(left.pop(0))
        if batch:
            out.append(batch)
    return sorted(sorted(b) for b in out)


def batches_of(spark, lengths, budget):
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n long")
    got = defaultdict(list)
    for r in batching.token_budget_batches(df, "n", budget, ["id"]).collect():
        got[r["batch_id"]].append(r["length"])
    assert sorted(got) == list(range(1, len(got) + 1))
    return sorted(sorted(b) for b in got.values())


RNG = random.Random(5)


@pytest.mark.parametrize(
    "lengths, budget",
    [
        ([50] * 20 + [400, 410, 420], 1000),
        ([100] * 10, 500),
        ([2000, 50, 100], 1000),
        ([100, 200, 50], 500),
        ([0] * 5 + [3, 3, 7], 10),
        ([0, 0], 10),
        ([RNG.randrange(0, 300) for _ in range(700)], 1000),
        ([RNG.choice([30, 31, 90]) for _ in range(500)], 333),
    ],
)
def test_batches_follow_the_rule(spark, lengths, budget):
    assert batches_of(spark, lengths, budget) == greedy(lengths, budget)


def test_batches_go_by_length_and_key(spark):
    """The same rows share a batch however many partitions hold them."""
    rng = random.Random(11)
    df = spark.createDataFrame([(i, rng.choice([5, 7, 7, 7])) for i in range(3000)], "id long, n long")
    want = sorted(df.collect(), key=lambda r: (-r["n"], r["id"]))
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = batching.token_budget_batches(df, "n", 60, ["id"]).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        order = sorted(got, key=lambda r: (r["batch_id"], -r["length"], r["id"]))
        assert [r["id"] for r in order] == [r["id"] for r in want]


def test_batch_edges(spark):
    empty = spark.createDataFrame([], "id long, n long")
    assert batching.token_budget_batches(empty, "n", 10, ["id"]).count() == 0
    for budget in (0, -1):
        with pytest.raises(ValueError, match="token budget"):
            batching.token_budget_batches(empty, "n", budget, ["id"])
    estimate = batching.estimated_batches(spark.createDataFrame([(1, 7), (2, 4)], "id long, n long"), "n", 10)
    assert estimate.first()["estimated_batches"] == 2


def proteins_of(spark, n=300):
    rng = random.Random(2)
    rows = [("p", f"orf{i}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYU") for _ in range(rng.randrange(0, 90)))) for i in range(n)]
    df = spark.createDataFrame(rows, "parent_id string, orf_id string, protein_aa string")
    return df.withColumn("aa_length", F.length("protein_aa"))


def strict_encoder(budget):
    def factory():
        def encode(texts):
            assert len(texts) == 1 or len(texts) * max(map(len, texts)) <= budget
            return [t.lower() + "extra" for t in texts]

        return encode

    return factory


@pytest.mark.parametrize("how", ["task", "global"])
def test_encoding(spark, how):
    proteins = proteins_of(spark)
    encoded = encode_proteins(proteins, strict_encoder(500), 500, model_name="m", batching=how)
    rows = encoded.collect()
    assert len(rows) == 300 and unencoded(proteins, encoded).count() == 0
    assert all(r["three_di"] == r["protein_aa"].lower() and r["model_name"] == "m" for r in rows)
    constant = encode_proteins(proteins, constant_encoder, text=encoder_prompt("protein_aa"), batching=how)
    assert constant.where("length(three_di) <> aa_length or three_di rlike '[^a]'").count() == 0


@pytest.mark.parametrize("how", ["task", "global"])
@pytest.mark.parametrize("result", [lambda t: ["a"], lambda t: [None] * len(t)])
def test_encoder_contract(spark, how, result):
    with pytest.raises(Exception, match="encoder (returned|left)"):
        encode_proteins(proteins_of(spark, 20), lambda: result, batching=how).collect()


@pytest.mark.parametrize("n, fraction", [(10, 0.2), (1000, 0.1), (7, 0.0), (7, 1.0), (3, 0.3)])
def test_exact_split(spark, n, fraction):
    rows = splits.exact_split(spark.range(n), fraction, ["id"])
    assert rows.where("held_out").count() == int(n * fraction)
    again = splits.exact_split(spark.range(n).repartition(5), fraction, ["id"])
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def test_split_with_narrow_digests(spark, monkeypatch):
    monkeypatch.setattr(splits, "_DIGITS", 1)
    for k in (0.001, 0.37, 0.999):
        assert splits.exact_split(spark.range(1000), k, ["id"]).where("held_out").count() == int(1000 * k)
    same = spark.range(10).withColumn("key", F.lit(1))
    with pytest.raises(ValueError, match="do not identify"):
        splits.exact_split(same, 0.5, ["key"])


@pytest.mark.parametrize("groups, train", [(10, 8), (2, 1), (3, 2), (101, 80)])
def test_group_split(spark, groups, train):
    df = spark.range(1000).withColumn("file", F.concat(F.lit("f"), F.col("id") % groups))
    check = splits.split_check(splits.group_split(df, "file"), "file").first()
    assert tuple(check) == (groups, 0, train, groups - train)


def test_group_split_errors(spark):
    one = spark.range(5).withColumn("file", F.lit("f"))
    with pytest.raises(ValueError, match="at least 2"):
        splits.group_split(one, "file")
    for ratio in (0, 1, 1.5):
        with pytest.raises(ValueError, match="between 0 and 1"):
            splits.group_split(one, "file", ratio)


@pytest.mark.parametrize("levels", [1, 2, 7, 100_000])
def test_auc_against_pairs(spark, levels):
    rng = random.Random(levels)
    rows = []
    for _ in range(400):
        label = rng.random() < 0.3
        rows.append((int(label), rng.randrange(levels) / levels * 0.7 + 0.3 * label * rng.random() * (levels > 1)))
    df = spark.createDataFrame(rows, "label int, probability double")
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    assert metrics.roc_auc(df.where("label = 0")).first()["auc"] == 0.0


def test_report_without_positives(spark):
    df = spark.createDataFrame([(0, 0)], "label int, predicted_label int")
    row = metrics.classification_report(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def rows(spark):
    """Separable rows: annotated ORFs are long."""
    rng = random.Random(8)
    data = []
    for i in range(400):
        label = i % 2
        n = rng.randrange(200, 400) if label else rng.randrange(30, 150)
        data.append((f"file{i % 10}", f"orf{i}", 1.9, 3.0 + label, 2.0, 3 * n, n, n, i, i + 3 * n, True, 1.0, True, True, bool(label)))
    names = ", ".join(f"{c} {t}" for c, t in zip(FEATURE_NAMES, ["double"] * 3 + ["int"] * 5 + ["boolean", "double", "boolean", "boolean"]))
    return feature_matrix(
        spark.createDataFrame(data, f"source_file string, orf_id string, {names.replace(' end ', ' `end` ')}, in_genbank boolean")
    ).cache()


def test_incomplete_rows_are_left_out(spark):
    gaps = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "dna_entropy double, protein_entropy double")
    assert tuple(incomplete(gaps).first()) == (2, 1)


@pytest.mark.parametrize("kind, params", [("xgboost", {"n_estimators": 5}), ("neural_net", {"epochs": 30})])
def test_training(spark, rows, tmp_path, kind, params):
    path = str(tmp_path / "model")
    training = jobs.train_by_group(rows, "source_file", ["orf_id"], kind, model_path=path, **params)
    validation, test = training.validation.first(), training.test.first()
    assert validation["train_samples"] + validation["val_samples"] == 320 and validation["val_samples"] == 64
    assert test["accuracy"] > 0.9 and ("auc" in test.asDict()) == (kind == "xgboost")
    predictions = training.predictions.collect()
    assert len(predictions) == 80
    assert all(r["correct"] == (r["predicted_label"] == r["actual_label"]) for r in predictions)
    assert all(abs(r["probability_in_genbank"] + r["probability_not_in_genbank"] - 1) < 1e-9 for r in predictions)
    loaded = {r["orf_id"]: r["prob_in_genbank"] for r in jobs.score(rows, path, str(tmp_path / "out")).collect()}
    assert all(loaded[r["orf_id"]] == r["probability_in_genbank"] for r in predictions)
    again = OrfClassifier.load(path)
    assert (again.model_type, again.seed, again.params) == (kind, 43, params)
    written = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out"))
    assert written.columns == ["orf_id", "predicted_label", "prob_not_in_genbank", "prob_in_genbank", "in_genbank"]
    assert written.count() == 400
    if kind == "xgboost":
        importance = {r["feature"]: r["importance"] for r in training.importance.collect()}
        assert sum(importance.values()) == pytest.approx(1.0) and len(importance) == 12
        assert training.classifier.top_features(10).count() == 10
    else:
        assert training.importance is None
    training.write(str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/test_metrics")).count() == 1


def test_classifier_errors():
    with pytest.raises(ValueError, match="unknown model type"):
        OrfClassifier("forest")


def test_untrained(spark, rows):
    with pytest.raises(RuntimeError, match="not trained"):
        OrfClassifier("xgboost").predict(rows)


def test_exact_quantiles(spark):
    import numpy as np

    from codonlake.operators.quantiles import exact_quantiles

    rng = random.Random(12)
    rows = [(g, rng.choice([None, rng.random(), 0.5])) for g in [True, False, None] for _ in range(2000)] + [(True, 2.0)]
    df = spark.createDataFrame(rows, "g boolean, v double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "g", "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in (True, False, None):
        values = [v for h, v in rows if h is g and v is not None]
        assert got[g] == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]).tolist())


def test_rows_without_label_are_scored_but_not_trained_on(spark):
    flat = spark.createDataFrame(
        [("p", f"o{i}", 1.0, 2.0, 3.0, 9, 3, 3, 1, 9, True, 1, True, True, [True, None][i % 2]) for i in range(4)],
        "parent_id string, orf_id string, dna_entropy double, protein_entropy double, three_di_entropy double, dna_length int,"
        " protein_length int, three_di_length int, start int, end int, strand_plus boolean, frame int, has_start_codon boolean,"
        " has_stop_codon boolean, in_genbank boolean",
    )
    from codonlake.operators.features import feature_matrix

    assert sorted(str(r["label"]) for r in feature_matrix(flat).collect()) == ["1", "1", "None", "None"]
