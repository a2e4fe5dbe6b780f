"""Queries over the given tables, by name. ``oracle_queries`` holds their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codonlake.alphabets import ALPHABET_SIZES
from codonlake.functions import (
    classes_to_three_di,
    encoder_prompt,
    replace_rare_residues,
    reverse_complement,
    sequence_entropy,
    shannon_entropy,
    strip_trailing_stop,
    trim_to_length,
)
from codonlake.operators import assemble, batching, labels, levels, metrics, splits, summaries, validation
from codonlake.operators.binding import compute_once
from codonlake.operators.classifier import OrfClassifier
from codonlake.operators.encoding import encode_proteins, unencoded
from codonlake.operators.features import feature_matrix, incomplete
from codonlake.operators.matching import match_annotated
from codonlake.operators.orfs import (
    annotate_orfs,
    attach_orf_sequences,
    find_orfs,
    find_orfs_in_chunks,
    sequences_without_orfs,
    six_frames,
)
from codonlake.operators.proteins import derive_proteins, translate_orfs, translation_mismatches
from codonlake.plans import derived as d, jobs
from codonlake.session import scratch_path, spread, stored, stored_by
from codonlake.sources import fasta, genbank, orf_fasta, reports, results, stages

KEYS = ["parent_id", "orf_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def orf_rows(orfs: DataFrame, *extra) -> DataFrame:
    return orfs.select(
        *KEYS,
        big("start").alias("start"),
        big("end").alias("end"),
        "strand",
        big("frame").alias("frame"),
        F.md5("nt_sequence").alias("nt_md5"),
        F.md5("aa_sequence").alias("aa_md5"),
        *extra,
    )


def features(spark, sf_dir, **options) -> DataFrame:
    return jobs.feature_table(
        d.sequences(spark, sf_dir),
        d.coding_sequences(spark, sf_dir),
        encoder_factory=d.stand_in_encoder,
        lengths=d.lengths(spark, sf_dir),
        **options,
    )


def stored_features(spark, sf_dir) -> DataFrame:
    """Features written once to shared storage, for jobs that read them often."""
    return stored_by(features(spark, sf_dir, together=True), "parent_id", scratch_path(spark, "features"))


# --- entropy -----------------------------------------------------------------


@query
def entropy_of_documents(spark, sf_dir):
    """Plain symbol entropy of whole document texts."""
    return d.documents(spark, sf_dir).select("doc_id", r6(shannon_entropy("text")).alias("entropy"))


@query
def entropy_of_pages(spark, sf_dir):
    pages = spread(d.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", r6(shannon_entropy("html")).alias("entropy"))


@query
def entropy_of_part_names(spark, sf_dir):
    """Case-folded entropy of short ASCII strings."""
    return d.table(spark, sf_dir, "part").select("p_partkey", r6(sequence_entropy("p_name")).alias("entropy"))


@query
def entropy_normalized(spark, sf_dir):
    """DNA entropy as a share of two bits."""
    seqs = d.sequences(spark, sf_dir)
    return seqs.select("seq_id", r6(sequence_entropy("seq", ALPHABET_SIZES["dna"], normalize=True)).alias("entropy"))


@query
def global_dna_entropy(spark, sf_dir):
    return levels.global_entropy(d.sequences(spark, sf_dir)).select(
        "seq_id", big("dna_length").alias("dna_length"), r6("dna_entropy_global").alias("dna_entropy_global")
    )


@query
def symbol_counts(spark, sf_dir):
    """Symbol counts per sequence, counted in chunks."""
    return levels.symbol_counts(d.sequences(spark, sf_dir)).select("seq_id", "symbol", big("n").alias("n"))


@query
def entropy_from_symbol_counts(spark, sf_dir):
    counts = levels.symbol_counts(d.sequences(spark, sf_dir))
    return levels.entropy_from_counts(counts).select(
        "seq_id", big("n_symbols").alias("n_symbols"), r6("entropy").alias("entropy")
    )


@query
def level_entropies(spark, sf_dir):
    """Nucleotide, protein and structural entropy of every ORF with its annotation."""
    return summaries.level_comparison(features(spark, sf_dir)).select(
        *KEYS, "in_genbank", *[r6(c).alias(c) for c in ("dna_entropy", "protein_entropy", "three_di_entropy")]
    )


@query
def level_entropies_normalized(spark, sf_dir):
    """The entropy job on stored structural records, normalised by alphabet."""
    path = scratch_path(spark, "three-di")
    encoded = encode_proteins(d.proteins(spark, sf_dir), d.stand_in_encoder)
    stages.write_three_di(encoded, path)
    table = jobs.entropy_table(stages.read_three_di(spark, path, json_lines=True), normalize=True)
    return table.select(*KEYS, *[r6(c).alias(c) for c in table.columns[2:]])


@query
def low_complexity_proteins(spark, sf_dir):
    proteins = compute_once(d.proteins(spark, sf_dir), h=sequence_entropy("protein_aa"))
    return proteins.where(labels.is_low_complexity(F.round("h", 9))).select(*KEYS, r6("h").alias("protein_entropy"))


# --- frames, ORFs, translation ----------------------------------------------


@query
def six_frame_expansion(spark, sf_dir):
    return six_frames(d.sequences(spark, sf_dir)).select(
        "seq_id", "strand", big("frame").alias("frame"), F.md5("bases").alias("bases_md5")
    )


@query
def reverse_complements(spark, sf_dir):
    return d.sequences(spark, sf_dir).select("seq_id", F.md5(reverse_complement("seq")).alias("rc_md5"))


@query
def open_reading_frames(spark, sf_dir):
    """ORFs of at least 90 bases with running ids, flags and residues."""
    return orf_rows(d.orfs(spark, sf_dir), "has_start_codon", "has_stop_codon")


@query
def open_reading_frames_long(spark, sf_dir):
    """Minimum length given in residues."""
    return orf_rows(d.orfs(spark, sf_dir, min_nt_length=60 * 3))


@query
def open_reading_frames_table_4(spark, sf_dir):
    """Another genetic code: TGA codes for tryptophan."""
    return orf_rows(d.orfs(spark, sf_dir, table_id=4))


@query
def open_reading_frames_from_start(spark, sf_dir):
    """ORFs from their first ATG to the stop."""
    found = annotate_orfs(find_orfs(d.sequences(spark, sf_dir), require_start=True))
    return orf_rows(found).drop("orf_id")


@query
def orf_nucleotides_by_coordinate(spark, sf_dir):
    """Coordinates joined back to their parents."""
    seqs = d.sequences(spark, sf_dir)
    found, _ = attach_orf_sequences(find_orfs(seqs, bases=False, lengths=d.lengths(spark, sf_dir)), seqs)
    return found.select(*KEYS, F.md5("nt_sequence").alias("nt_md5"))


@query
def orf_parent_missing(spark, sf_dir):
    """ORFs whose parent is not among the annotated sequences."""
    _, orphans = attach_orf_sequences(
        find_orfs(d.sequences(spark, sf_dir), bases=False, lengths=d.lengths(spark, sf_dir)), d.annotated_sequences(spark, sf_dir)
    )
    return orphans.select(*KEYS)


@query
def sequences_lacking_orfs(spark, sf_dir):
    seqs = d.sequences(spark, sf_dir)
    found = find_orfs(seqs, bases=False, lengths=d.lengths(spark, sf_dir))
    return sequences_without_orfs(seqs, found).select("seq_id", big(F.length("seq")).alias("dna_length"))


@query
def proteins_of_orfs(spark, sf_dir):
    return translate_orfs(d.orfs(spark, sf_dir)).select(
        *KEYS, F.md5("protein_aa").alias("protein_md5"), big("aa_length").alias("aa_length")
    )


@query
def translation_mismatch(spark, sf_dir):
    """ORFs whose supplied residues were altered: a leading M is put as L."""
    altered = d.orfs(spark, sf_dir).withColumn("aa_sequence", F.regexp_replace("aa_sequence", "^M", "L"))
    return translation_mismatches(altered).select(*KEYS, F.md5("translated").alias("translated_md5"))


@query
def translation_rejects_dropped(spark, sf_dir):
    altered = d.orfs(spark, sf_dir).withColumn("aa_sequence", F.regexp_replace("aa_sequence", "^M", "L"))
    return translate_orfs(altered, on_mismatch="reject").select(*KEYS, big("aa_length").alias("aa_length"))


@query
def row_validation(spark, sf_dir):
    """Line items read as ORF rows; every row gets its problem or none."""
    rows = d.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("?").alias("strand"),
        (F.col("l_linenumber") - 1).alias("frame"),
        (F.col("l_partkey") - 50).alias("start"),
        (F.col("l_partkey") - 60 + F.col("l_quantity").cast("int")).alias("end"),
    )
    valid, rejected = validation.split_valid(rows, validation.orf_problem())
    both = valid.withColumn("problem", F.lit("valid")).unionByName(rejected)
    return both.groupBy("problem", "strand").agg(big(F.count("*")).alias("n"), big(F.sum("start")).alias("sum_start"))


@query
def protein_length_validation(spark, sf_dir):
    """Proteins whose stated length still counts the stop."""
    stated = d.proteins(spark, sf_dir).withColumn("aa_length", F.length("aa_sequence"))
    _, rejected = validation.split_valid(stated, validation.protein_problem())
    return rejected.select(*KEYS, big("aa_length").alias("aa_length"), "problem")


# --- residues and encoder texts ---------------------------------------------


@query
def rare_residues(spark, sf_dir):
    return d.protein_sequences(spark, sf_dir).select(
        "seq_id", F.md5(replace_rare_residues("seq")).alias("residues_md5")
    )


@query
def encoder_prompts(spark, sf_dir):
    prompts = d.protein_sequences(spark, sf_dir).select("seq_id", encoder_prompt("seq").alias("prompt"))
    return prompts.select("seq_id", big(F.length("prompt")).alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


@query
def class_letters(spark, sf_dir):
    """Vector components as class ids, cut to a length that differs by row."""
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 20)
    n = F.col("vec_id") % (F.size("embedding") + 1)
    return d.table(spark, sf_dir, "embeddings").select("vec_id", classes_to_three_di(ids, n).alias("three_di"))


@query
def trimmed_structures(spark, sf_dir):
    """Structural strings over the residues with the stop, cut to the protein."""
    proteins = d.proteins(spark, sf_dir).withColumn("three_di", F.translate("aa_sequence", "*", "D"))
    return proteins.select(*KEYS, F.md5(trim_to_length("three_di", "aa_length")).alias("three_di_md5"))


@query
def encoding_methods(spark, sf_dir):
    size = F.col("p_size")
    model = (
        F.when(size <= 16, labels.BASE_MODEL).when(size <= 33, labels.PROFILES_MODEL).otherwise(F.col("p_type"))
    )
    parts = d.table(spark, sf_dir, "part").select(model.alias("model_name"))
    return parts.groupBy("model_name", labels.encoding_method(F.col("model_name")).alias("method")).agg(
        F.count("*").alias("n")
    )


@query
def encoded_proteins(spark, sf_dir):
    """The encoder hook with a stand-in rule, batched inside the tasks."""
    encoded = encode_proteins(d.proteins(spark, sf_dir), d.stand_in_encoder, model_name=labels.BASE_MODEL)
    return encoded.select(*KEYS, F.md5("three_di").alias("three_di_md5"), "method", "model_name", "inference_device")


@query
def encoded_proteins_in_global_batches(spark, sf_dir):
    """The same in the exact batches of the whole table, from a stored table."""
    encoded = encode_proteins(stored(d.proteins(spark, sf_dir), "proteins"), d.stand_in_encoder, batching="global")
    return encoded.select(*KEYS, F.md5("three_di").alias("three_di_md5"), "method")


@query
def protein_placeholders(spark, sf_dir):
    """Protein FASTA written and read back as protein records."""
    path = scratch_path(spark, "faa")
    fasta.write_fasta(d.protein_sequences(spark, sf_dir), path)
    records = fasta.read_protein_fasta(spark, path)
    return records.select(
        *KEYS,
        big("start").alias("start"),
        big("end").alias("end"),
        "strand",
        big("frame").alias("frame"),
        "nt_sequence",
        big("table_id").alias("table_id"),
        "has_start_codon",
        "has_stop_codon",
        "in_genbank",
        F.md5("protein_aa").alias("protein_md5"),
        big("aa_length").alias("aa_length"),
    )


# --- batches -------------------------------------------------------------------


def _batches(spark, sf_dir) -> DataFrame:
    return batching.token_budget_batches(d.proteins(spark, sf_dir), "aa_length", 10_000, KEYS)


@query
def token_budget_batches(spark, sf_dir):
    """Rows, longest row and total length of each batch over the whole table."""
    report = batching.batch_report(_batches(spark, sf_dir))
    return report.select(*[big(c).alias(c) for c in report.columns])


@query
def batch_estimate(spark, sf_dir):
    return batching.estimated_batches(d.proteins(spark, sf_dir), "aa_length", 10_000)


# --- annotation match ------------------------------------------------------------


@query
def c_terminal_match(spark, sf_dir):
    return d.matched_orfs(spark, sf_dir).select(*KEYS, "in_genbank")


@query
def c_terminal_match_same_parent(spark, sf_dir):
    return d.matched_orfs(spark, sf_dir, same_parent=True).select(*KEYS, "in_genbank")


@query
def c_terminal_match_long_tail(spark, sf_dir):
    return d.matched_orfs(spark, sf_dir, n=40).select(*KEYS, "in_genbank")


# --- stage joins -------------------------------------------------------------------


@query
def stages_merged(spark, sf_dir):
    """Stored stages joined; proteins with a start and long structures only."""
    path = scratch_path(spark, "orfs")
    stages.write_orfs(d.orfs(spark, sf_dir), path)
    orfs = stages.read_orfs(spark, path, json_lines=True)
    proteins = derive_proteins(orfs)
    three_di = encode_proteins(proteins, d.stand_in_encoder)
    merged = assemble.merge_stages(orfs, proteins.where("has_start_codon"), three_di.where("aa_length >= 40"))
    return merged.select(*KEYS, big("aa_length").alias("aa_length"), F.md5("three_di").alias("three_di_md5"))


@query
def stage_completeness(spark, sf_dir):
    """Expected and actual features per sequence when some stages lack rows."""
    orfs = stored(d.orfs(spark, sf_dir, bases=False).select("parent_id", "has_start_codon"), "starts")
    return assemble.completeness(orfs, orfs.where("has_start_codon")).select(
        "parent_id", big("expected").alias("expected"), big("actual").alias("actual")
    )


@query
def entropy_attached(spark, sf_dir):
    """Entropies joined by ORF; ORFs without a start have none and get 0."""
    # what is measured is kept of ORFs with a start alone
    texts = [F.when(F.col("has_start_codon"), F.col(c)).alias(c) for c in ("nt_sequence", "protein_aa")]
    proteins = stored(d.proteins(spark, sf_dir).select(*KEYS, "has_start_codon", *texts), "proteins").withColumn("three_di", F.lit(""))
    entropies = levels.level_entropies(proteins.where("has_start_codon"))
    joined = assemble.attach_entropy(proteins, entropies)
    return joined.select(
        *KEYS, *[r6(c).alias(c) for c in ("dna_entropy", "protein_entropy", "three_di_entropy")]
    )


# --- summaries ------------------------------------------------------------------------


@query
def run_totals(spark, sf_dir):
    totals = summaries.run_totals(d.sequences(spark, sf_dir), d.matched_proteins(spark, sf_dir))
    return totals.select(*[big(c).alias(c) for c in totals.columns])


@query
def summary_by_sequence(spark, sf_dir):
    """ORF count, mean protein length and mean entropies per document."""
    proteins = d.proteins(spark, sf_dir)
    measured = levels.add_entropy(
        levels.add_entropy(proteins, "nt_sequence", "dna_entropy"), "protein_aa", "protein_entropy"
    )
    return summaries.by_sequence(measured).select(
        "parent_id",
        "n_orfs",
        r6("mean_protein_length").alias("mean_protein_length"),
        r6("mean_dna_entropy").alias("mean_dna_entropy"),
        r6("mean_protein_entropy").alias("mean_protein_entropy"),
    )


@query
def comparison_report(spark, sf_dir):
    """Protein against structural entropy, by annotation."""
    report = summaries.comparison_report(features(spark, sf_dir))
    return report.select(
        "in_genbank", "n", *[r6(c).alias(c) for c in report.columns if c not in ("in_genbank", "n")]
    )


@query
def filtered_features(spark, sf_dir):
    kept = labels.filter_features(
        d.matched_orfs(spark, sf_dir), strand="-", has_stop_codon=True, in_genbank=True
    )
    return kept.select(*KEYS, big("start").alias("start"))


@query
def protein_lengths(spark, sf_dir):
    return labels.sequence_lengths(d.orfs(spark, sf_dir)).groupBy(big("length").alias("length")).agg(
        F.count("*").alias("n")
    )


@query
def first_features(spark, sf_dir):
    """The first five rows in a stated order."""
    rows = d.matched_orfs(spark, sf_dir).select(*KEYS, "in_genbank", big("start").alias("start"))
    return labels.first_rows(rows, "parent_id", "start", "orf_id")


@query
def longest_proteins(spark, sf_dir):
    """Ordered by length: the ten longest."""
    rows = d.proteins(spark, sf_dir).select(*KEYS, big("aa_length").alias("aa_length"))
    return labels.first_rows(rows, F.desc("aa_length"), "parent_id", "orf_id", n=10)


# --- splits --------------------------------------------------------------------------


@query
def row_split(spark, sf_dir):
    """Exactly a tenth of the documents held out."""
    docs = d.table(spark, sf_dir, "documents").select("doc_id")
    return splits.exact_split(docs, 0.1, ["doc_id"], seed=42)


@query
def row_split_twice(spark, sf_dir):
    """A tenth for the test, then a fifth of the rest for validation."""
    rows = d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ids = rows.groupBy(*keys).agg(F.count("*").alias("copies")).drop("copies")
    rest = splits.exact_split(ids, 0.1, keys, 42, "is_test").where(~F.col("is_test")).drop("is_test")
    return splits.exact_split(rest, 0.2, keys, 43, "is_validation").groupBy("is_validation").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("sum_orderkey")
    )


@query
def group_split(spark, sf_dir):
    """Whole sources to train or test."""
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.group_split(docs, "source", 0.8, 42)


@query
def group_split_check(spark, sf_dir):
    """No source on both sides and none missing."""
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.split_check(splits.group_split(docs, "source", 0.8, 42), "source")


# --- classifier rows and metrics --------------------------------------------------------


@query
def classifier_features(spark, sf_dir):
    matrix = feature_matrix(features(spark, sf_dir))
    return matrix.select(
        *KEYS,
        *[r6(c).alias(c) for c in matrix.columns if c not in (*KEYS, "label")],
        big("label").alias("label"),
    )


@query
def incomplete_features(spark, sf_dir):
    """Line items with gaps read as features: rows that lack one are counted."""
    gaps = d.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("dna_entropy"),
        F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("protein_entropy"),
        F.col("l_quantity").alias("start"),
    )
    return incomplete(gaps)


@query
def label_distribution(spark, sf_dir):
    rows = d.matched_orfs(spark, sf_dir).select(F.col("in_genbank").cast("int").alias("label"))
    return summaries.label_distribution(rows).select(big("label").alias("label"), "n")


@query
def class_imbalance(spark, sf_dir):
    rows = d.matched_orfs(spark, sf_dir).select(F.col("in_genbank").cast("int").alias("label"))
    return summaries.class_imbalance(rows).select(r6("positive_ratio").alias("positive_ratio"), "imbalanced")


@query
def confusion_and_scores(spark, sf_dir):
    report = metrics.classification_report(d.scored(spark, sf_dir))
    return report.select(
        *[c for c in report.columns if c.startswith(("true", "false"))],
        *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
    )


@query
def area_under_curve(spark, sf_dir):
    return metrics.roc_auc(d.scored(spark, sf_dir)).select(r6("auc").alias("auc"))


@query
def validation_loss(spark, sf_dir):
    loss = metrics.log_loss(d.scored(spark, sf_dir))
    return loss.select(r6("log_loss").alias("log_loss"), r6("error").alias("error"))


@query
def predicted_class_counts(spark, sf_dir):
    counts = metrics.prediction_counts(d.scored(spark, sf_dir))
    return counts.select(big("predicted_label").alias("predicted_label"), "n")


@query
def confidence_bands(spark, sf_dir):
    rows = d.scored(spark, sf_dir)
    p = F.col("probability")
    return rows.groupBy(labels.confidence_band(p).alias("band"), "label").agg(
        F.count("*").alias("n"),
        F.count_if(labels.predicted_label(p, 0.7) == 1).alias("n_strict"),
        F.count_if(labels.predicted_label(p, 0.3) == 1).alias("n_permissive"),
    )


@query
def prediction_file(spark, sf_dir):
    """Predictions written as tab-separated text and read back as text."""
    path = scratch_path(spark, "predictions")
    p = F.col("probability")
    rows = d.scored(spark, sf_dir).withColumn("prob_in_genbank", p).withColumn("prob_not_in_genbank", 1 - p)
    rows = rows.withColumn("orf_id", F.concat_ws("/", *KEYS))
    reports.write_predictions(rows, path)
    return spark.read.option("sep", "\t").option("header", True).csv(path)


# --- files -----------------------------------------------------------------------------


@query
def fasta_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    fasta.write_fasta(d.sequences(spark, sf_dir), path)
    return fasta.read_fasta(spark, path).select("seq_id", F.md5("seq").alias("seq_md5"))


@query
def fasta_chunks_round_trip(spark, sf_dir):
    """Records read as chunks of 1 kb and put together again."""
    path = scratch_path(spark, "fasta")
    fasta.write_fasta(d.sequences(spark, sf_dir), path)
    chunks = fasta.read_fasta_chunks(spark, path, 1000)
    parts = F.array_sort(F.collect_list(F.struct("chunk", "bases"))).getField("bases")
    return chunks.groupBy("row", "seq_id").agg(F.md5(F.array_join(parts, "")).alias("seq_md5")).drop("row")


@query
def open_reading_frames_in_chunks(spark, sf_dir):
    """ORFs of FASTA records that were never whole rows: chunks of 999 bases."""
    path = scratch_path(spark, "fasta")
    fasta.write_fasta(d.sequences(spark, sf_dir), path)
    found = find_orfs_in_chunks(fasta.read_fasta_chunks(spark, path, 999, overlap=2), 999)
    return orf_rows(annotate_orfs(found), "has_start_codon", "has_stop_codon")


@query
def fasta_gzip_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fasta-gz")
    fasta.write_fasta(d.sequences(spark, sf_dir), path, compression="gzip")
    return fasta.read_fasta(spark, path).select("seq_id", F.md5("seq").alias("seq_md5"))


@query
def fasta_all_records(spark, sf_dir):
    """Records of one id, the source, kept apart: the iterator form."""
    path = scratch_path(spark, "fasta-source")
    docs = d.sequences(spark, sf_dir).join(
        d.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("seq_id"), "source"), "seq_id"
    )
    fasta.write_fasta(docs.select(F.col("source").alias("seq_id"), "seq"), path)
    records = fasta.read_fasta(spark, path, dedup=False)
    return records.groupBy("seq_id").agg(F.count("*").alias("n"), big(F.sum(F.length("seq"))).alias("bases"))


@query
def fasta_last_record_wins(spark, sf_dir):
    """Turns of a conversation under one id, in one ordered file: the last stays."""
    path = scratch_path(spark, "fasta-turns")
    turns = d.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("seq_id"),
        "turn",
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"),
    )
    ordered = turns.repartitionByRange("seq_id").sortWithinPartitions("seq_id", "turn")
    fasta.write_fasta(ordered.select("seq_id", "seq"), path)
    return fasta.read_fasta(spark, path).select("seq_id", F.md5("seq").alias("seq_md5"))


def _genbank_text(spark, sf_dir) -> str:
    """GenBank records of the annotated documents with their coding sequences."""
    path = scratch_path(spark, "genbank")
    cds = d.coding_sequences(spark, sf_dir)
    span = F.concat(F.col("start") + 1, F.lit(".."), F.col("end"))
    location = F.when(F.col("strand") == "-", F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)
    indent = "\n" + " " * 21
    wrapped = F.regexp_replace("protein_sequence", "(.{58})(?=.)", f"$1{indent}")
    block = F.concat(
        F.lit("\n     CDS             "), location, F.lit(f'{indent}/codon_start=1{indent}/translation="'), wrapped, F.lit('"')
    )
    blocks = cds.groupBy("parent_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("strand", "start", block.alias("b")))), lambda x: x["b"]), "").alias("features")
    )
    seqs = d.sequences(spark, sf_dir)
    version = F.concat(F.lit("DOC"), F.col("seq_id"), F.lit(".1"))
    bases = F.regexp_replace(F.regexp_replace(F.lower("seq"), "(.{60})(?=.)", "$1\n        1 "), "([acgt]{10})(?=[acgt])", "$1 ")
    text = F.concat(
        F.lit("LOCUS       DOC"), F.col("seq_id"), F.lit(" "), F.length("seq"), F.lit(" bp    DNA     linear   BCT\nVERSION     "),
        version,
        F.lit("\nFEATURES             Location/Qualifiers\n     source          1.."), F.length("seq"),
        F.coalesce("features", F.lit("")),
        F.lit("\nORIGIN\n        1 "), bases, F.lit("\n//"),
    )
    seqs.join(blocks, seqs["seq_id"] == blocks["parent_id"], "left").select(text.alias("value")).write.text(path, compression="gzip")
    return path


@query
def genbank_sequences(spark, sf_dir):
    seqs = genbank.read_genbank(spark, _genbank_text(spark, sf_dir))
    return seqs.select("seq_id", F.md5("seq").alias("seq_md5"))


@query
def genbank_coding_sequences(spark, sf_dir):
    cds = genbank.read_cds(spark, _genbank_text(spark, sf_dir))
    return cds.select(
        "parent_id",
        big("start").alias("start"),
        big("end").alias("end"),
        "strand",
        F.md5("protein_sequence").alias("protein_md5"),
    )


@query
def orf_fasta_ingest(spark, sf_dir):
    """ORFs written with coordinates in their headers, then read and looked up."""
    path = scratch_path(spark, "orf-fasta")
    signed = F.concat(F.when(F.col("strand") == "-", "-").otherwise("+"), F.col("frame"))
    header = F.concat(
        F.lit(">"), F.col("parent_id"), F.lit("-"), F.col("orf_id"), F.lit(" ["), F.col("parent_id"),
        F.lit(" frame "), signed, F.lit(" "), F.col("start"), F.lit(" "), F.col("end"), F.lit("]\n"), F.col("aa_sequence"),
    )
    d.orfs(spark, sf_dir).select(header.alias("value")).write.text(path)
    found, _ = orf_fasta.read_orf_fasta(spark, path, d.sequences(spark, sf_dir))
    return orf_rows(found, "has_start_codon", "has_stop_codon")


def _result_files(spark, sf_dir, stored: DataFrame | None = None) -> str:
    path = scratch_path(spark, "results")
    if stored is None:
        # the results hold the residues of a protein, not those of its ORF as well
        stored = stored_by(features(spark, sf_dir, together=True).drop("aa_sequence"), "parent_id", scratch_path(spark, "features"))
    heads = jobs.result_headers(d.sequences(spark, sf_dir), stored)
    results.write_results(results.nest_features(stored, heads), path, compression="gzip")
    return path


@query
def result_files(spark, sf_dir):
    """Nested results written as JSON and read back: one row per sequence."""
    read = results.read_results(spark, _result_files(spark, sf_dir), json_lines=True)
    return read.select(
        "input_id",
        "schema_version",
        "input_dna_length",
        r6("dna_entropy_global").alias("dna_entropy_global"),
        big(F.coalesce(F.try_element_at("alphabet_sizes", F.lit("protein")), F.lit(0))).alias("protein_alphabet"),
        big(F.size("features")).alias("n_features"),
    )


@query
def result_features(spark, sf_dir):
    """Flat features out of the nested result files."""
    read = results.read_results(spark, _result_files(spark, sf_dir), json_lines=True)
    rows = results.flat_features(read)
    return rows.select(
        *KEYS, "start", "strand", "dna_length", "protein_length", "in_genbank",
        r6("dna_entropy").alias("dna_entropy"), r6("three_di_entropy").alias("three_di_entropy"),
    )


@query
def result_lookup(spark, sf_dir):
    """One feature by its id from every result."""
    read = results.read_results(spark, _result_files(spark, sf_dir), json_lines=True, only=["orf1"])
    return results.lookup_feature(read, "orf1").select(
        "input_id", "orf_id", F.col("location.start").alias("start"), F.md5("protein.aa_sequence").alias("protein_md5")
    )


def _list_results(features: DataFrame) -> DataFrame:
    """Results in the older form: three lists per sequence, laid out of one list of rows after the shuffle."""
    row = F.struct(
        stages.nest_orf().alias("orf"), "aa_length", "three_di", "method", "model_name", "inference_device",
        "dna_entropy", "protein_entropy",
    )

    def protein(x):
        # the residues of an ORF but for its stop, so they are not shuffled twice
        residues = strip_trailing_stop(x["orf"]["aa_sequence"])
        return F.struct(x["orf"].alias("orf"), residues.alias("aa_sequence"), x["aa_length"].alias("aa_length"))

    def three_di(x):
        rest = [x[name].alias(name) for name in ("three_di", "method", "model_name", "inference_device")]
        return F.struct(protein(x).alias("protein"), *rest)

    def entropy(name):
        return F.map_from_entries(F.transform("rows", lambda x: F.struct(x["orf"]["orf_id"].alias("orf_id"), x[name].alias(name))))

    lists = features.groupBy(F.col("parent_id").alias("input_id")).agg(F.collect_list(row).alias("rows"))
    nothing = F.expr("cast(map() as map<string,double>)")
    report = F.struct(
        F.lit(0.0).alias("dna_entropy_global"),
        entropy("dna_entropy").alias("orf_nt_entropy"),
        entropy("protein_entropy").alias("protein_aa_entropy"),
        nothing.alias("three_di_entropy"),
        levels.alphabet_sizes().alias("alphabet_sizes"),
    )
    return lists.select(
        "input_id",
        F.transform("rows", lambda x: x["orf"]).alias("orfs"),
        F.transform(F.filter("rows", lambda x: x["orf"]["has_start_codon"]), protein).alias("proteins"),
        F.transform("rows", three_di).alias("three_dis"),
        report.alias("entropy"),
    )


@query
def list_results_unified(spark, sf_dir):
    """The older form read, converted and flattened; ORFs without a protein drop."""
    path = scratch_path(spark, "list-results")
    _list_results(features(spark, sf_dir)).write.json(path, compression="gzip")
    rows = results.flat_features(results.read_results(spark, path, json_lines=True))
    return rows.select(
        *KEYS, "strand", "protein_length", r6("dna_entropy").alias("dna_entropy"),
        r6("three_di_entropy").alias("three_di_entropy"), F.md5("three_di").alias("three_di_md5"),
    )


@query
def list_results_completeness(spark, sf_dir):
    """ORFs before and features after the conversion, per sequence."""
    path = scratch_path(spark, "list-results")
    _list_results(features(spark, sf_dir)).write.json(path, compression="gzip")
    counts = results.conversion_counts(results.read_results(spark, path, json_lines=True))
    return counts.select("input_id", F.lit("lists").alias("format"), big("expected").alias("expected"), big("actual").alias("actual"))


@query
def list_results_rewritten(spark, sf_dir):
    """The older form converted, written in the unified form and looked up."""
    path = scratch_path(spark, "rewritten")
    _list_results(features(spark, sf_dir)).write.json(f"{path}/lists", compression="gzip")
    read = results.read_results(spark, f"{path}/lists", json_lines=True)
    results.write_results(read, f"{path}/unified", compression="gzip")
    read = results.read_results(spark, f"{path}/unified", json_lines=True)
    return read.select("input_id", "schema_version", big(F.size("features")).alias("n_features"))


@query
def result_files_listed(spark, sf_dir):
    """Which files the results came from: how many, and that all were read."""
    read = results.read_results(spark, _result_files(spark, sf_dir), json_lines=True)
    per_file = read.groupBy("source_file", "format").agg(F.count("*").alias("n"))
    return per_file.groupBy("format").agg(F.sum("n").alias("n_results"))


@query
def result_files_of_both_forms(spark, sf_dir):
    """Both forms, gzipped and plain, read at once from a list of files."""
    path = scratch_path(spark, "list-results")
    rows = stored_features(spark, sf_dir)
    _list_results(rows).write.json(path)
    files = [f for folder in (_result_files(spark, sf_dir, rows), path) for f in spark.read.text(folder).inputFiles()]
    read = results.read_results(spark, files, json_lines=True)
    n_files = results.source_files(read)
    gzipped = F.endswith("source_file", F.lit(".gz"))
    per_file = read.groupBy("source_file", "format").agg(F.count("*").alias("n"))
    counts = per_file.join(n_files, "source_file").groupBy("format", gzipped.alias("gzipped")).agg(F.sum("n").alias("n_results"))
    features_of = results.flat_features(read).groupBy(gzipped.alias("gz")).agg(F.count("*").alias("n_features"))
    return counts.join(features_of, F.col("gzipped") == F.col("gz")).drop("gz")


@query
def fasta_files_refused(spark, sf_dir):
    """Files by source, every other one without headers: those are reported."""
    path = scratch_path(spark, "fasta-by-source")
    docs = d.sequences(spark, sf_dir).join(
        d.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("seq_id"), "source"), "seq_id"
    )
    odd = F.substring("source", 4, 9).cast("int") % 2 == 1
    text = F.when(odd, F.col("seq")).otherwise(fasta.fasta_text())
    docs.repartition("source").select("source", text.alias("value")).write.partitionBy("source").text(path)
    found = fasta.fasta_problems(spark, path)
    return found.select(F.regexp_extract("file", "source=([^/]+)", 1).alias("source"), "problem").distinct()


@query
def encoded_without_gaps(spark, sf_dir):
    """The encode job from a table and from FASTA: the same strings, and no protein left out."""
    proteins = stored(d.proteins(spark, sf_dir, bases=False).select(*KEYS, "protein_aa", "aa_length"), "proteins")
    path = scratch_path(spark, "faa")
    name = F.concat_ws("/", *KEYS).alias("seq_id")
    fasta.write_fasta(proteins.where("protein_aa <> ''").select(name, F.col("protein_aa").alias("seq")), path)
    from_table = jobs.encode_table(proteins, d.stand_in_encoder, batching="global")
    from_fasta = jobs.encode_table(fasta.read_protein_fasta(spark, path), d.stand_in_encoder)
    left = unencoded(proteins, from_table).agg(F.count("*").alias("n_left"))
    alike = from_table.select(name, "three_di").join(from_fasta.select(F.col("orf_id").alias("seq_id"), F.col("three_di").alias("other")), "seq_id")
    counts = alike.agg(F.count("*").alias("n_both"), F.count_if(F.col("three_di") == F.col("other")).alias("n_alike"))
    one = F.lit(1).alias("_one")
    return left.select("*", one).join(counts.select("*", one), "_one").drop("_one")


#: Results of every sequence in the full runs, so that no row grows with the largest one.
PARTS = 16


@query
def genbank_run(spark, sf_dir):
    """The full run from GenBank files alone, and its nested results."""
    path = scratch_path(spark, "genbank-run")
    _, nested = jobs.run(spark, path, genbank=_genbank_text(spark, sf_dir), parts=PARTS, encoder_factory=d.stand_in_encoder)
    return results.flat_features(nested).select(
        *KEYS, "start", "end", "strand", "in_genbank", "protein_length", r6("dna_entropy").alias("dna_entropy")
    )


@query
def full_run(spark, sf_dir):
    """From FASTA and GenBank files to stored features and results."""
    path = scratch_path(spark, "run")
    fasta.write_fasta(d.sequences(spark, sf_dir), f"{path}/input", compression="gzip")
    rows, _ = jobs.run(
        spark,
        path,
        fasta=f"{path}/input",
        genbank=_genbank_text(spark, sf_dir),
        parts=PARTS,
        compression="gzip",
        encoder_factory=d.stand_in_encoder,
    )
    return rows.select(
        *KEYS,
        big("start").alias("start"),
        big("end").alias("end"),
        "strand",
        "in_genbank",
        big("aa_length").alias("aa_length"),
        *[r6(c).alias(c) for c in ("dna_entropy", "protein_entropy", "three_di_entropy")],
    )


# --- models ---------------------------------------------------------------------------


def _model_rows(spark, sf_dir) -> DataFrame:
    docs = d.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("parent_id"), "source")
    options = {"encoder_factory": d.stand_in_encoder, "lengths": d.lengths(spark, sf_dir)}
    rows = jobs.training_matrix(d.sequences(spark, sf_dir), d.coding_sequences(spark, sf_dir), **options)
    return stored(rows.join(docs, "parent_id"), "matrix")


@query
def train_trees_by_source(spark, sf_dir):
    """Boosted trees trained on some sources and tested on the others."""
    return jobs.train_by_group(_model_rows(spark, sf_dir), "source", KEYS).test


@query
def stored_model_agrees(spark, sf_dir):
    """A model scores alike before and after it is stored; probabilities and labels are sound on every row."""
    path = scratch_path(spark, "model")
    rows = _model_rows(spark, sf_dir)
    fresh = jobs.train_by_group(rows, "source", KEYS, model_path=path).classifier.predict(rows)
    p, q = F.col("prob_in_genbank"), F.col("prob_not_in_genbank")
    again = jobs.score(rows, path).select(*KEYS, p.alias("p_again"))
    both = fresh.select(*KEYS, p, q, "predicted_label").join(again, KEYS)
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if(p == F.col("p_again")).alias("n_alike"),
        F.count_if(F.abs(p + q - 1) < 1e-9).alias("n_sum_one"),
        F.count_if(F.col("predicted_label") == (p > 0.5).cast("int")).alias("n_label_follows"),
    )


@query
def training_report(spark, sf_dir):
    """The report of a training, written and read back: samples by source, and that its tables agree."""
    path = scratch_path(spark, "report")
    jobs.train_by_group(_model_rows(spark, sf_dir), "source", KEYS).write(path)
    read = lambda name: spark.read.json(f"{path}/{name}")
    samples, test = read("samples"), read("test_metrics").first()
    n_test = samples.where("side = 'test'").agg(F.sum("n")).first()[0]
    counted = sum(test[c] for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))
    importance = read("feature_importance").agg(F.count("*"), F.sum("importance")).first()
    names = {r["name"] for r in read("parameters").collect()}
    sound = (
        n_test == counted == read("test_predictions").count()
        and importance[0] == 12
        and abs(importance[1] - 1) < 1e-6
        and {"model_type", "random_seed", "validation_split", "n_features"} <= names
    )
    return samples.select("side", "source", big("label").alias("label"), "n", F.lit(bool(sound)).alias("sound"))


@query
def train_trees_by_row(spark, sf_dir):
    """Boosted trees with a random tenth held out; per-row predictions."""
    return jobs.train_by_row(_model_rows(spark, sf_dir), KEYS).predictions


@query
def train_net_by_source(spark, sf_dir):
    return jobs.train_by_group(_model_rows(spark, sf_dir), "source", KEYS, model_type="neural_net").test


@query
def tree_feature_importance(spark, sf_dir):
    """The ten features that matter most to the trees."""
    classifier = OrfClassifier("xgboost")
    classifier.fit(_model_rows(spark, sf_dir), KEYS)
    return classifier.top_features()


@query
def stored_model_scores(spark, sf_dir):
    """A model saved, loaded and applied to all rows."""
    path = scratch_path(spark, "model")
    rows = _model_rows(spark, sf_dir)
    jobs.train_by_group(rows, "source", KEYS, model_path=path)
    scored = jobs.score(rows, path)
    return scored.select(*KEYS, "predicted_label", "prob_not_in_genbank", "prob_in_genbank", "label")
