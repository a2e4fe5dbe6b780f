"""End-to-end jobs. Each builds one DataFrame chain and writes where told."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.alphabets import (
    DEFAULT_C_TERMINAL,
    DEFAULT_ENCODING_SIZE,
    DEFAULT_MIN_AA_LENGTH,
    DEFAULT_MIN_NT_LENGTH,
    DEFAULT_TABLE_ID,
)
from codonlake.operators.classifier import OrfClassifier
from codonlake.operators.encoding import Encoder, constant_encoder, encode_proteins
from codonlake.operators.features import FEATURE_NAMES, feature_matrix
from codonlake.operators.levels import alphabet_sizes, empty_alphabet_sizes, global_entropy, level_entropies
from codonlake.operators.matching import match_annotated, matched_tails
from codonlake.operators.orfs import annotate_orfs, find_orfs
from codonlake.operators.proteins import derive_proteins, translate_orfs
from codonlake.operators.splits import exact_split, group_split
from codonlake.session import stored, stored_by
from codonlake.sources.genbank import read_inputs
from codonlake.sources.reports import report_predictions, write_predictions
from codonlake.sources.results import flat_features, nest_features, read_results, write_results


def orf_table(
    seqs: DataFrame, table_id: int = DEFAULT_TABLE_ID, min_nt_length: int = DEFAULT_MIN_NT_LENGTH, **options
) -> DataFrame:
    """ORF job: annotated ORFs of all sequences; ``options`` (``bases``, ``lengths``) go to the search."""
    return annotate_orfs(find_orfs(seqs, table_id, min_nt_length, residues=True, **options), table_id)


def protein_table(orfs: DataFrame, table_id: int = DEFAULT_TABLE_ID, on_mismatch: str = "fail") -> DataFrame:
    """Translate job over stored ORFs."""
    return translate_orfs(orfs, table_id, on_mismatch)


def encode_table(
    proteins: DataFrame,
    encoder_factory: Callable[[], Encoder] = constant_encoder,
    encoding_size: int = DEFAULT_ENCODING_SIZE,
    **options,
) -> DataFrame:
    """Encode job over stored proteins or protein FASTA records; fails if a protein stays without an encoding.

    ``options`` go to the encoder step: prompt ``text``, ``model_name``, ``device``, ``batching``.
    """
    if options.get("batching") == "global":
        proteins = stored(proteins, "proteins")
    # every protein has its row here, so those without an encoding need no join
    encoded = stored(encode_proteins(proteins, encoder_factory, encoding_size, **options), "encoded")
    if not encoded.where(F.col("three_di").isNull()).isEmpty():
        raise ValueError("some proteins have no encoding")
    return encoded


def entropy_table(three_di: DataFrame, normalize: bool = False) -> DataFrame:
    """Entropy job over stored structural records."""
    return level_entropies(three_di, normalize).select(
        "parent_id", "orf_id", "dna_entropy", "protein_entropy", "three_di_entropy"
    )


def feature_table(
    seqs: DataFrame,
    cds: DataFrame | None = None,
    table_id: int = DEFAULT_TABLE_ID,
    min_aa_length: int = DEFAULT_MIN_AA_LENGTH,
    encoder_factory: Callable[[], Encoder] = constant_encoder,
    model_name: str = "",
    encoding_size: int = DEFAULT_ENCODING_SIZE,
    compute_entropy: bool = True,
    c_terminal: int = DEFAULT_C_TERMINAL,
    lengths: DataFrame | None = None,
    together: bool = False,
) -> DataFrame:
    """Flat features of all ORFs, from sequences to entropies.

    Only the match against ``cds`` joins anything, ORFs with tails. With ``together`` ids and tails of ORFs that a search
    without bases finds are joined, and then the sequences to their tails: that is a second search, but no ORF is
    moved and those of a sequence lie together, as ``stored_by`` wants them. Every other step works inside the row. Store the result as Parquet to query it by column.
    """
    options = {}
    if cds is not None and together:
        known = orf_table(seqs, table_id, min_aa_length * 3, lengths=lengths, bases=False)
        options = {"matched": matched_tails(known, cds, c_terminal), "c_terminal": c_terminal}
    orfs = orf_table(seqs, table_id, min_aa_length * 3, lengths=lengths, **options)
    if cds is not None and not together:
        orfs = match_annotated(orfs, cds, c_terminal)
    encoded = encode_proteins(
        derive_proteins(orfs), encoder_factory, encoding_size, model_name=model_name
    )
    if compute_entropy:
        return level_entropies(encoded)
    return encoded.withColumns({f"{level}_entropy": F.lit(0.0) for level in ("dna", "protein", "three_di")})


def training_matrix(seqs: DataFrame, cds: DataFrame, c_terminal: int = DEFAULT_C_TERMINAL, **options) -> DataFrame:
    """Classifier rows of all ORFs, labelled by ``cds``; ``options`` as of ``feature_table``.

    Numbers are taken before the match, so that no sequence is shuffled and ORFs are searched once.
    """
    lengths = {"dna_length": "nt_sequence", "protein_length": "protein_aa", "three_di_length": "three_di"}
    kept = [name for name in FEATURE_NAMES if name not in (*lengths, "strand_plus")]
    rows = feature_table(seqs, **options).select(
        "parent_id", "orf_id", "strand", "aa_sequence", *kept, *[F.length(seq).alias(name) for name, seq in lengths.items()]
    )
    return feature_matrix(match_annotated(rows, cds, c_terminal))


def result_headers(seqs: DataFrame, features: DataFrame, compute_entropy: bool = True) -> DataFrame:
    """One row per sequence; without ORFs or entropies the alphabet map is empty."""
    heads = global_entropy(seqs).select(
        F.col("seq_id").alias("input_id"),
        F.col("dna_length").alias("input_dna_length"),
        F.col("dna_entropy_global") if compute_entropy else F.lit(0.0).alias("dna_entropy_global"),
    )
    with_orfs = features.select(F.col("parent_id").alias("input_id")).distinct().withColumn("_found", F.lit(True))
    sizes = F.when(F.col("_found") & F.lit(compute_entropy), alphabet_sizes()).otherwise(empty_alphabet_sizes())
    return heads.join(with_orfs, "input_id", "left").withColumn("alphabet_sizes", sizes).drop("_found")


def run(
    spark: SparkSession,
    output: str,
    fasta=None,
    genbank=None,
    compute_entropy: bool = True,
    validate: bool = True,
    parts: int = 1,
    compression: str = "none",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Full run over files: ``(features, results)``, both written below ``output``.

    Flat features are stored first as Parquet, in buckets of their sequence, and the nested results
    (``compression`` is that of their files) are made from that table without moving them, so no ORF is computed twice and a lost executor costs
    only its own tasks. With ``parts`` every sequence, large or small,
    becomes up to so many results, for input whose largest one would not fit a row.
    """
    seqs, cds = read_inputs(spark, fasta, genbank, validate)
    features = stored_by(feature_table(seqs, cds, compute_entropy=compute_entropy, together=True, **options), "parent_id", f"{output}/features")
    heads = result_headers(seqs, features, compute_entropy)
    write_results(nest_features(features, heads, parts=parts), f"{output}/results", compression)
    return features, read_results(spark, f"{output}/results", json_lines=True)


def result_features(results: DataFrame) -> DataFrame:
    """Classifier rows of result files of either form."""
    return feature_matrix(flat_features(results))


@dataclass
class Training:
    """What a training job leaves behind."""

    classifier: OrfClassifier
    parameters: dict
    validation: DataFrame
    test: DataFrame
    predictions: DataFrame
    importance: DataFrame | None
    samples: DataFrame

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Report as JSON tables: parameters, samples, metrics, predictions and importance."""
        spark = self.test.sparkSession
        text = {k: json.dumps(v) for k, v in self.parameters.items()}
        spark.createDataFrame(list(text.items()), "name string, value string").coalesce(1).write.mode(mode).json(
            f"{path}/parameters"
        )
        self.samples.write.mode(mode).json(f"{path}/samples")
        self.validation.write.mode(mode).json(f"{path}/training_metrics")
        self.test.write.mode(mode).json(f"{path}/test_metrics")
        self.predictions.write.mode(mode).json(f"{path}/test_predictions")
        if self.importance is not None:
            self.importance.write.mode(mode).json(f"{path}/feature_importance")


def _train(split: DataFrame, groups, keys, model_type, validation_split, seed, model_path, params) -> Training:
    """Train on one side of ``split`` and test on the other; the matrix with its sides is stored and read from there."""
    split = stored(split, "split-matrix")
    train, test = (split.where(F.col("side") == side).drop("side") for side in ("train", "test"))
    classifier = OrfClassifier(model_type, seed, **params)
    validation = classifier.fit(train, keys, validation_split)
    if model_path:
        classifier.save(model_path)
    parameters = {
        "model_type": model_type,
        "estimator": type(classifier.estimator).__name__,
        "validation_split": validation_split,
        "random_seed": seed,
        "n_features": len(FEATURE_NAMES),
        "feature_names": FEATURE_NAMES,
        **params,
    }
    scored = stored(classifier.predict(test), "test-predictions")
    return Training(
        classifier,
        parameters,
        validation,
        classifier.metrics(scored),
        report_predictions(scored),
        classifier.feature_importance(),
        split.groupBy("side", *groups, "label").agg(F.count("*").alias("n")),
    )


def train_by_row(
    features: DataFrame,
    keys: list[str],
    model_type: str = "xgboost",
    test_split: float = 0.1,
    validation_split: float = 0.2,
    seed: int = 42,
    model_path: str | None = None,
    **params,
) -> Training:
    """Hold out rows for the test, then train on the rest."""
    split = exact_split(features.dropna(subset=["label"]), test_split, keys, seed, "_test")
    split = split.withColumn("side", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")
    return _train(split, [], keys, model_type, validation_split, seed + 1, model_path, params)


def train_by_group(
    features: DataFrame,
    group: str,
    keys: list[str],
    model_type: str = "xgboost",
    train_ratio: float = 0.8,
    validation_split: float = 0.2,
    seed: int = 42,
    model_path: str | None = None,
    **params,
) -> Training:
    """Hold out whole groups, such as result files, for the test."""
    split = group_split(features.dropna(subset=["label"]), group, train_ratio, seed)
    return _train(split, [group], keys, model_type, validation_split, seed + 1, model_path, params)


def score(features: DataFrame, model_path: str, output: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Apply a stored model; with ``output`` also write the prediction file."""
    scored = OrfClassifier.load(model_path).predict(features, threshold)
    if output:
        write_predictions(scored, output)
    return scored
