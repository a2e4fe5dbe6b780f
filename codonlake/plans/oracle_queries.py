"""SQL of each query in ``queries.py`` whose result SQL can state."""

from __future__ import annotations

from codonlake.operators.labels import BASE_MODEL, METHOD_BASE, METHOD_OTHER, METHOD_PROFILES, PROFILES_MODEL
from codonlake.plans.oracle import (
    CDS,
    DNA,
    FEATURES,
    LETTERS_OF,
    MATCHED,
    ORF_ROW,
    ORFS,
    PROTEIN_TEXT,
    SCORED,
    STRANDS,
    entropy_of,
    orf_entropy,
    orfs_cte,
)
from codonlake.plans.derived import STAND_IN_FROM, STAND_IN_TO

THREE_DI_LETTERS = "ACDEFGHIKLMNPQRSTVWY"
ENCODED = f"translate(protein_aa, '{STAND_IN_FROM}', '{STAND_IN_TO}')"
FLAGS = "has_start_codon, has_stop_codon"


def entropy_query(table: str, key: str, text: str) -> str:
    return f"""
WITH t AS (SELECT {key}, {text} AS text FROM {table}),{entropy_of("t", key, "text")}
SELECT {key}, round(entropy, 6) AS entropy FROM h"""


def digest(seed: int, *keys: str) -> str:
    return "md5('" + str(seed) + "' || " + " || ".join(f"':' || {k}" for k in keys) + ")"


def split_by_rank(relation: str, columns: str, order: str, count: str, name: str) -> str:
    return f"""
SELECT {columns}, row_number() OVER (ORDER BY {order}) <= {count} AS {name} FROM {relation}"""


LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

MATCHED_TAIL = """,
m AS (
  SELECT o.parent_id, o.orf_id, {hit} AS in_genbank FROM orfs o
)
SELECT parent_id, orf_id, in_genbank FROM m"""

GROUPS = f"""
groups AS (SELECT DISTINCT source FROM documents),
sides AS (
  SELECT source, CASE WHEN row_number() OVER (ORDER BY {digest(42, "source")})
    <= greatest(1, least(CAST(floor((SELECT count(*) FROM groups) * 0.8) AS BIGINT), (SELECT count(*) FROM groups) - 1))
    THEN 'train' ELSE 'test' END AS side
  FROM groups
)"""

LIST_FEATURES = f"""{FEATURES},
kept AS (SELECT * FROM features WHERE has_start_codon)"""

BATCHES = f"""
WITH RECURSIVE {ORFS},
ranked AS (
  SELECT row_number() OVER (ORDER BY aa_length DESC, parent_id, orf_id) AS r, aa_length FROM orfs
),
cuts(batch_id, first_row, size) AS (
  SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), greatest(1, 10000 // greatest(aa_length, 1)) FROM ranked WHERE r = 1
  UNION ALL
  SELECT batch_id + 1, first_row + size, greatest(1, 10000 // greatest(aa_length, 1))
  FROM cuts JOIN ranked ON r = first_row + size
)
SELECT batch_id, count(*) AS n_sequences, max(aa_length) AS max_length, CAST(sum(aa_length) AS BIGINT) AS total_length
FROM cuts JOIN ranked ON r >= first_row AND r < first_row + size
GROUP BY batch_id"""

ORACLE: dict[str, str] = {
    # entropy
    "entropy_of_documents": entropy_query("documents", "doc_id", "text"),
    "entropy_of_pages": entropy_query("pages", "page_id", "html"),
    "entropy_of_part_names": entropy_query("part", "p_partkey", "upper(p_name)"),
    "entropy_normalized": f"""
WITH {DNA},{entropy_of("dna", "seq_id", "seq")}
SELECT seq_id, round(entropy / log2(4), 6) AS entropy FROM h""",
    "global_dna_entropy": f"""
WITH {DNA},{entropy_of("dna", "seq_id", "seq")}
SELECT seq_id, length(seq) AS dna_length, round(entropy, 6) AS dna_entropy_global FROM h JOIN dna USING (seq_id)""",
    "symbol_counts": f"""
WITH {DNA}, symbols AS (SELECT seq_id, unnest(string_split(seq, '')) AS symbol FROM dna WHERE seq <> '')
SELECT seq_id, symbol, count(*) AS n FROM symbols GROUP BY ALL""",
    "entropy_from_symbol_counts": f"""
WITH {DNA},{entropy_of("dna", "seq_id", "seq")}
SELECT seq_id, length(seq) AS n_symbols, round(entropy, 6) AS entropy FROM h JOIN dna USING (seq_id) WHERE seq <> ''""",
    "level_entropies": f"""
WITH {FEATURES}
SELECT parent_id, orf_id, in_genbank, round(dna_entropy, 6) AS dna_entropy,
       round(protein_entropy, 6) AS protein_entropy, round(three_di_entropy, 6) AS three_di_entropy FROM features""",
    "level_entropies_normalized": f"""
WITH {FEATURES}
SELECT parent_id, orf_id, round(dna_entropy / log2(4), 6) AS dna_entropy,
       round(protein_entropy / log2(20), 6) AS protein_entropy,
       round(three_di_entropy / log2(20), 6) AS three_di_entropy FROM features""",
    "low_complexity_proteins": f"""
WITH {ORFS},{orf_entropy("h", "orfs", "protein_aa")}
SELECT parent_id, orf_id, round(entropy, 6) AS protein_entropy FROM h WHERE round(entropy, 9) < 2.0""",
    # frames, ORFs, translation
    "six_frame_expansion": f"""
WITH {DNA},{STRANDS}
SELECT seq_id, strand, CAST(frame AS BIGINT) AS frame, md5(substr(bases, frame)) AS bases_md5
FROM strands, (VALUES (1),(2),(3)) AS f(frame)""",
    "reverse_complements": f"""
WITH {DNA} SELECT seq_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_md5 FROM dna""",
    "open_reading_frames": f"WITH {ORFS} SELECT {ORF_ROW}, {FLAGS} FROM orfs",
    "open_reading_frames_in_chunks": f"WITH {ORFS} SELECT {ORF_ROW}, {FLAGS} FROM orfs",
    "open_reading_frames_long": f"WITH {orfs_cte(min_nt=180)} SELECT {ORF_ROW} FROM orfs",
    "open_reading_frames_table_4": f"WITH {orfs_cte(table_id=4)} SELECT {ORF_ROW} FROM orfs",
    "open_reading_frames_from_start": f"""
WITH {orfs_cte(min_nt=3)},
stopped AS (
  SELECT *, list_position(regexp_extract_all(nt_sequence, '...'), 'ATG') AS first_atg
  FROM orfs WHERE has_stop_codon
),
cut AS (
  SELECT parent_id, strand, frame, "end", "start" + 3 * (first_atg - 1) AS "start",
         substr(nt_sequence, 3 * (first_atg - 1) + 1) AS nt_sequence, substr(aa_sequence, first_atg) AS aa_sequence
  FROM stopped WHERE first_atg > 0
)
SELECT parent_id, "start", "end", strand, frame, md5(nt_sequence) AS nt_md5, md5(aa_sequence) AS aa_md5
FROM cut WHERE length(nt_sequence) >= 90""",
    "orf_nucleotides_by_coordinate": f"""
WITH {ORFS}
SELECT o.parent_id, o.orf_id, md5(substr(bases, "start", "end" - "start" + 1)) AS nt_md5
FROM orfs o JOIN strands s ON s.seq_id = o.parent_id AND s.strand = o.strand""",
    "orf_parent_missing": f"""
WITH {ORFS}
SELECT parent_id, orf_id FROM orfs
WHERE parent_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""",
    "sequences_lacking_orfs": f"""
WITH {ORFS}
SELECT seq_id, length(seq) AS dna_length FROM dna WHERE seq_id NOT IN (SELECT parent_id FROM orfs)""",
    "proteins_of_orfs": f"""
WITH {ORFS} SELECT parent_id, orf_id, md5(protein_aa) AS protein_md5, aa_length FROM orfs""",
    "translation_mismatch": f"""
WITH {ORFS} SELECT parent_id, orf_id, md5(aa_sequence) AS translated_md5 FROM orfs WHERE aa_sequence LIKE 'M%'""",
    "translation_rejects_dropped": f"""
WITH {ORFS} SELECT parent_id, orf_id, aa_length FROM orfs WHERE aa_sequence NOT LIKE 'M%'""",
    "row_validation": """
WITH rows AS (
  SELECT CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '?' END AS strand, l_linenumber - 1 AS frame,
         l_partkey - 50 AS "start", l_partkey - 60 + CAST(l_quantity AS INT) AS "end"
  FROM lineitem
),
checked AS (
  SELECT *, CASE WHEN strand = '?' THEN 'invalid strand' WHEN frame NOT BETWEEN 0 AND 3 THEN 'invalid frame'
    WHEN "start" < 0 THEN 'invalid start' WHEN "end" <= "start" THEN 'invalid end' ELSE 'valid' END AS problem
  FROM rows
)
SELECT problem, strand, count(*) AS n, CAST(sum("start") AS BIGINT) AS sum_start FROM checked GROUP BY ALL""",
    "protein_length_validation": f"""
WITH {ORFS}
SELECT parent_id, orf_id, length(aa_sequence) AS aa_length, 'aa_length does not match the sequence' AS problem
FROM orfs WHERE has_stop_codon""",
    # residues and encoder texts
    "rare_residues": f"""
WITH {PROTEIN_TEXT} SELECT seq_id, md5(translate(seq, 'UZOB', 'XXXX')) AS residues_md5 FROM prot""",
    "encoder_prompts": f"""
WITH {PROTEIN_TEXT}, prompts AS (
  SELECT seq_id, '<AA2fold> ' || array_to_string(string_split(translate(seq, 'UZOB', 'XXXX'), ''), ' ') AS prompt FROM prot
)
SELECT seq_id, length(prompt) AS prompt_length, md5(prompt) AS prompt_md5 FROM prompts""",
    "class_letters": f"""
WITH ids AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x, len(embedding) AS n FROM embeddings
),
letters AS (
  SELECT vec_id, string_agg(
    substr('{THREE_DI_LETTERS}', CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 20 + 1, 1), '' ORDER BY i) AS s
  FROM ids WHERE i <= vec_id % (n + 1) GROUP BY vec_id
)
SELECT e.vec_id, coalesce(s, '') AS three_di FROM embeddings e LEFT JOIN letters USING (vec_id)""",
    "trimmed_structures": f"""
WITH {ORFS}
SELECT parent_id, orf_id, md5(substr(replace(aa_sequence, '*', 'D'), 1, aa_length)) AS three_di_md5 FROM orfs""",
    "encoding_methods": f"""
WITH m AS (
  SELECT CASE WHEN p_size <= 16 THEN '{BASE_MODEL}' WHEN p_size <= 33 THEN '{PROFILES_MODEL}' ELSE p_type END AS model_name
  FROM part
)
SELECT model_name, CASE model_name WHEN '{BASE_MODEL}' THEN '{METHOD_BASE}' WHEN '{PROFILES_MODEL}' THEN
  '{METHOD_PROFILES}' ELSE '{METHOD_OTHER}' END AS method, count(*) AS n FROM m GROUP BY ALL""",
    "encoded_proteins": f"""
WITH {ORFS}
SELECT parent_id, orf_id, md5({ENCODED}) AS three_di_md5, '{METHOD_BASE}' AS method, '{BASE_MODEL}' AS model_name,
       'cpu' AS inference_device FROM orfs""",
    "encoded_proteins_in_global_batches": f"""
WITH {ORFS} SELECT parent_id, orf_id, md5({ENCODED}) AS three_di_md5, '{METHOD_OTHER}' AS method FROM orfs""",
    "protein_placeholders": f"""
WITH {PROTEIN_TEXT}
SELECT seq_id AS parent_id, seq_id AS orf_id, CAST(0 AS BIGINT) AS "start", length(seq) * 3 AS "end", '+' AS strand,
       CAST(0 AS BIGINT) AS frame, '' AS nt_sequence, CAST(11 AS BIGINT) AS table_id, false AS has_start_codon,
       false AS has_stop_codon, false AS in_genbank, md5(seq) AS protein_md5, length(seq) AS aa_length FROM prot""",
    # batches
    "token_budget_batches": BATCHES,
    "batch_estimate": f"""
WITH {ORFS}
SELECT count(*) AS n_sequences, CAST(ceil(sum(aa_length) / 10000) AS BIGINT) AS estimated_batches FROM orfs""",
    # annotation match
    "c_terminal_match": f"WITH {MATCHED} SELECT parent_id, orf_id, in_genbank FROM matched",
    "c_terminal_match_same_parent": f"WITH {ORFS},{CDS}"
    + MATCHED_TAIL.format(
        hit="(o.parent_id, right(rtrim(o.aa_sequence, '*'), 10)) IN "
        "(SELECT (c.parent_id, right(rtrim(c.protein_sequence, '*'), 10)) FROM cds c)"
    ),
    "c_terminal_match_long_tail": f"WITH {ORFS},{CDS}"
    + MATCHED_TAIL.format(
        hit="right(rtrim(o.aa_sequence, '*'), 40) IN (SELECT right(rtrim(c.protein_sequence, '*'), 40) FROM cds c)"
    ),
    # stage joins
    "stages_merged": f"""
WITH {ORFS}
SELECT parent_id, orf_id, aa_length, md5({ENCODED}) AS three_di_md5 FROM orfs WHERE has_start_codon AND aa_length >= 40""",
    "stage_completeness": f"""
WITH {ORFS}
SELECT parent_id, count(*) AS expected, count(*) FILTER (has_start_codon) AS actual FROM orfs GROUP BY parent_id""",
    "entropy_attached": f"""
WITH {ORFS},{orf_entropy("hd", "orfs", "nt_sequence")},{orf_entropy("hp", "orfs", "protein_aa")}
SELECT parent_id, orf_id, CASE WHEN has_start_codon THEN round(hd.entropy, 6) ELSE 0 END AS dna_entropy,
       CASE WHEN has_start_codon THEN round(hp.entropy, 6) ELSE 0 END AS protein_entropy,
       CAST(0 AS DOUBLE) AS three_di_entropy
FROM orfs JOIN hd USING (parent_id, orf_id) JOIN hp USING (parent_id, orf_id)""",
    # summaries
    "run_totals": f"""
WITH {MATCHED}
SELECT (SELECT count(*) FROM dna) AS n_sequences, count(*) AS n_orfs, count(protein_aa) AS n_proteins,
       count(*) FILTER (in_genbank) AS n_matched FROM matched""",
    "summary_by_sequence": f"""
WITH {ORFS},{orf_entropy("hd", "orfs", "nt_sequence")},{orf_entropy("hp", "orfs", "protein_aa")}
SELECT parent_id, count(*) AS n_orfs, round(avg(aa_length), 6) AS mean_protein_length,
       round(avg(hd.entropy), 6) AS mean_dna_entropy, round(avg(hp.entropy), 6) AS mean_protein_entropy
FROM orfs JOIN hd USING (parent_id, orf_id) JOIN hp USING (parent_id, orf_id) GROUP BY parent_id""",
    "comparison_report": f"""
WITH {FEATURES}
SELECT in_genbank, count(*) AS n, round(avg(protein_entropy), 6) AS mean_protein_entropy,
       round(avg(three_di_entropy), 6) AS mean_other_entropy, round(stddev_samp(protein_entropy), 6) AS sd_protein_entropy,
       round(corr(protein_entropy, three_di_entropy), 6) AS correlation,
       round(quantile_cont(protein_entropy, 0.25), 6) AS q1_protein_entropy,
       round(quantile_cont(protein_entropy, 0.5), 6) AS median_protein_entropy,
       round(quantile_cont(protein_entropy, 0.75), 6) AS q3_protein_entropy
FROM features GROUP BY in_genbank""",
    "filtered_features": f"""
WITH {MATCHED}
SELECT parent_id, orf_id, "start" FROM matched WHERE strand = '-' AND has_stop_codon AND in_genbank""",
    "protein_lengths": f"WITH {ORFS} SELECT length(aa_sequence) AS length, count(*) AS n FROM orfs GROUP BY 1",
    "first_features": f"""
WITH {MATCHED}
SELECT parent_id, orf_id, in_genbank, "start" FROM matched ORDER BY parent_id, "start", orf_id LIMIT 5""",
    "longest_proteins": f"""
WITH {ORFS} SELECT parent_id, orf_id, aa_length FROM orfs ORDER BY aa_length DESC, parent_id, orf_id LIMIT 10""",
    # splits
    "row_split": split_by_rank(
        "documents",
        "doc_id",
        digest(42, "doc_id"),
        "(SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM documents)",
        "held_out",
    ),
    "row_split_twice": f"""
WITH ids AS (SELECT DISTINCT {", ".join(LINE_KEYS)} FROM lineitem),
first_cut AS ({split_by_rank("ids", "*", digest(42, *LINE_KEYS),
    "(SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM ids)", "is_test")}),
rest AS (SELECT {", ".join(LINE_KEYS)} FROM first_cut WHERE NOT is_test),
second_cut AS ({split_by_rank("rest", "*", digest(43, *LINE_KEYS),
    "(SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM rest)", "is_validation")})
SELECT is_validation, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey FROM second_cut GROUP BY ALL""",
    "group_split": f"WITH {GROUPS} SELECT doc_id, source, side FROM documents JOIN sides USING (source)",
    "group_split_check": f"""
WITH {GROUPS}
SELECT count(*) AS n_groups, CAST(0 AS BIGINT) AS n_shared, count(*) FILTER (side = 'train') AS n_train,
       count(*) FILTER (side = 'test') AS n_test FROM sides""",
    # classifier rows and metrics
    "classifier_features": f"""
WITH {FEATURES}
SELECT parent_id, orf_id, round(dna_entropy, 6) AS dna_entropy, round(protein_entropy, 6) AS protein_entropy,
       round(three_di_entropy, 6) AS three_di_entropy, CAST(length(nt_sequence) AS DOUBLE) AS dna_length,
       CAST(aa_length AS DOUBLE) AS protein_length, CAST(length(three_di) AS DOUBLE) AS three_di_length,
       CAST("start" AS DOUBLE) AS "start", CAST("end" AS DOUBLE) AS "end", CAST(strand = '+' AS DOUBLE) AS strand_plus,
       CAST(frame AS DOUBLE) AS frame, CAST(has_start_codon AS DOUBLE) AS has_start_codon,
       CAST(has_stop_codon AS DOUBLE) AS has_stop_codon, CAST(in_genbank AS BIGINT) AS label
FROM features""",
    "incomplete_features": """
SELECT count(*) AS n_rows,
       count(*) FILTER (NOT (l_tax > CAST(0.01 AS DOUBLE) AND l_discount > CAST(0.01 AS DOUBLE))) AS n_incomplete
FROM lineitem""",
    "label_distribution": f"""
WITH {MATCHED} SELECT CAST(in_genbank AS BIGINT) AS label, count(*) AS n FROM matched GROUP BY 1""",
    "class_imbalance": f"""
WITH {MATCHED}, r AS (SELECT avg(CAST(in_genbank AS INT)) AS p FROM matched)
SELECT round(p, 6) AS positive_ratio, p < 0.1 OR p > 0.9 AS imbalanced FROM r""",
    "confusion_and_scores": f"""
WITH {SCORED}, c AS (
  SELECT count(*) FILTER (predicted_label = 1 AND label = 1) AS tp, count(*) FILTER (predicted_label = 0 AND label = 0) AS tn,
         count(*) FILTER (predicted_label = 1 AND label = 0) AS fp, count(*) FILTER (predicted_label = 0 AND label = 1) AS fn
  FROM predicted
)
SELECT tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
       round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM c""",
    "area_under_curve": f"""
WITH {SCORED}, ranked AS (
  SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2 AS r FROM scored
), s AS (SELECT sum(label) AS p, count(*) - sum(label) AS n, sum(r) FILTER (label = 1) AS ranks FROM ranked)
SELECT round((ranks - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s""",
    "validation_loss": f"""
WITH {SCORED}
SELECT round(avg(-(label * ln(probability) + (1 - label) * ln(1 - probability))), 6) AS log_loss,
       round(avg(CAST(predicted_label <> label AS INT)), 6) AS error FROM predicted""",
    "predicted_class_counts": f"""
WITH {SCORED} SELECT CAST(predicted_label AS BIGINT) AS predicted_label, count(*) AS n FROM predicted GROUP BY 1""",
    "confidence_bands": f"""
WITH {SCORED}
SELECT CASE WHEN greatest(probability, 1 - probability) > CAST(0.9 AS DOUBLE) THEN 'high'
            WHEN greatest(probability, 1 - probability) >= CAST(0.6 AS DOUBLE) THEN 'medium' ELSE 'low' END AS band,
       label, count(*) AS n, count(*) FILTER (probability > CAST(0.7 AS DOUBLE)) AS n_strict,
       count(*) FILTER (probability > CAST(0.3 AS DOUBLE)) AS n_permissive
FROM scored GROUP BY ALL""",
    "prediction_file": f"""
WITH {SCORED}
SELECT parent_id || '/' || orf_id AS orf_id, CAST(predicted_label AS VARCHAR) AS predicted_label,
       printf('%.6f', 1 - probability) AS prob_not_in_genbank, printf('%.6f', probability) AS prob_in_genbank,
       CASE WHEN label = 1 THEN 'true' ELSE 'false' END AS in_genbank
FROM predicted""",
    # files
    "fasta_round_trip": f"WITH {DNA} SELECT seq_id, md5(seq) AS seq_md5 FROM dna",
    "fasta_chunks_round_trip": f"WITH {DNA} SELECT seq_id, md5(seq) AS seq_md5 FROM dna",
    "fasta_gzip_round_trip": f"WITH {DNA} SELECT seq_id, md5(seq) AS seq_md5 FROM dna",
    "fasta_all_records": f"""
SELECT source AS seq_id, count(*) AS n, CAST(sum(length({LETTERS_OF})) AS BIGINT) AS bases FROM documents GROUP BY source""",
    "fasta_last_record_wins": f"""
SELECT CAST(conv_id AS VARCHAR) AS seq_id, md5(arg_max({LETTERS_OF}, turn)) AS seq_md5 FROM conversations GROUP BY conv_id""",
    "genbank_sequences": f"WITH {DNA} SELECT 'DOC' || seq_id || '.1' AS seq_id, md5(seq) AS seq_md5 FROM dna",
    "genbank_coding_sequences": f"""
WITH {ORFS},{CDS}
SELECT 'DOC' || parent_id || '.1' AS parent_id, "start", "end", strand, md5(protein_sequence) AS protein_md5 FROM cds""",
    "orf_fasta_ingest": f"WITH {ORFS} SELECT {ORF_ROW}, {FLAGS} FROM orfs",
    "result_files": f"""
WITH {ORFS},{entropy_of("dna", "seq_id", "seq")},
found AS (SELECT parent_id, count(*) AS n FROM orfs GROUP BY parent_id)
SELECT d.seq_id AS input_id, '2.0.0' AS schema_version, length(d.seq) AS input_dna_length,
       round(entropy, 6) AS dna_entropy_global, CASE WHEN n > 0 THEN 20 ELSE 0 END AS protein_alphabet,
       coalesce(n, 0) AS n_features
FROM dna d JOIN h USING (seq_id) LEFT JOIN found ON parent_id = d.seq_id""",
    "result_features": f"""
WITH {FEATURES}
SELECT parent_id, orf_id, "start", strand, length(nt_sequence) AS dna_length, aa_length AS protein_length, in_genbank,
       round(dna_entropy, 6) AS dna_entropy, round(three_di_entropy, 6) AS three_di_entropy FROM features""",
    "result_lookup": f"""
WITH {ORFS}
SELECT parent_id AS input_id, orf_id, "start", md5(protein_aa) AS protein_md5 FROM orfs WHERE orf_id = 'orf1'""",
    "list_results_unified": f"""
WITH {LIST_FEATURES}
SELECT parent_id, orf_id, strand, aa_length AS protein_length, round(dna_entropy, 6) AS dna_entropy,
       CAST(0 AS DOUBLE) AS three_di_entropy, md5(three_di) AS three_di_md5 FROM kept""",
    "list_results_completeness": f"""
WITH {ORFS}
SELECT parent_id AS input_id, 'lists' AS format, count(*) AS expected, count(*) FILTER (has_start_codon) AS actual
FROM orfs GROUP BY parent_id""",
    "list_results_rewritten": f"""
WITH {ORFS}
SELECT parent_id AS input_id, '2.0.0' AS schema_version, count(*) FILTER (has_start_codon) AS n_features
FROM orfs GROUP BY parent_id""",
    "result_files_listed": "SELECT 'unified' AS format, count(*) AS n_results FROM documents",
    "genbank_run": f"""
WITH {FEATURES}
SELECT 'DOC' || parent_id || '.1' AS parent_id, orf_id, "start", "end", strand, in_genbank, aa_length AS protein_length,
       round(dna_entropy, 6) AS dna_entropy FROM features""",
    "encoded_without_gaps": f"""
WITH {FEATURES}
SELECT 0 AS n_left, count(*) AS n_both, count(*) AS n_alike FROM features WHERE protein_aa <> ''""",
    "fasta_files_refused": """
SELECT DISTINCT source, 'sequence before header' AS problem FROM documents WHERE CAST(substr(source, 4) AS INT) % 2 = 1""",
    "result_files_of_both_forms": f"""
WITH {FEATURES}
SELECT 'lists' AS format, FALSE AS gzipped, count(DISTINCT parent_id) AS n_results,
       count(*) FILTER (has_start_codon) AS n_features FROM features
UNION ALL
SELECT 'unified', TRUE, (SELECT count(*) FROM documents), count(*) FROM features""",
    "stored_model_agrees": f"""
WITH {FEATURES}
SELECT count(*) AS n_rows, count(*) AS n_alike, count(*) AS n_sum_one, count(*) AS n_label_follows FROM features""",
    "training_report": f"""
WITH {GROUPS}, {FEATURES}
SELECT side, source, CAST(in_genbank AS BIGINT) AS label, count(*) AS n, TRUE AS sound
FROM features JOIN documents ON parent_id = CAST(doc_id AS VARCHAR) JOIN sides USING (source) GROUP BY ALL""",
    "full_run": f"""
WITH {FEATURES}
SELECT parent_id, orf_id, "start", "end", strand, in_genbank, aa_length, round(dna_entropy, 6) AS dna_entropy,
       round(protein_entropy, 6) AS protein_entropy, round(three_di_entropy, 6) AS three_di_entropy FROM features""",
}
