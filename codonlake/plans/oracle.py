"""The same queries in SQL for DuckDB, written independently of the operators.

ORFs are found here as gaps and islands over codon rows, where the operators
match whole runs in a string.
"""

from __future__ import annotations

from codonlake.alphabets import genetic_code, stop_codons
from codonlake.plans.derived import AS_BASES, LETTERS, STAND_IN_FROM, STAND_IN_TO

LETTERS_OF = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"

DNA = f"""
dna AS (
  SELECT CAST(doc_id AS VARCHAR) AS seq_id, translate({LETTERS_OF}, '{LETTERS}', '{AS_BASES}') AS seq
  FROM documents
)"""

PROTEIN_TEXT = f"""
prot AS (
  SELECT 'conv_' || conv_id || '_' || turn AS seq_id, {LETTERS_OF} AS seq FROM conversations
)"""

STRANDS = """
strands AS (
  SELECT seq_id, '+' AS strand, seq AS bases FROM dna
  UNION ALL
  SELECT seq_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM dna
)"""


def orfs_cte(table_id: int = 11, min_nt: int = 90) -> str:
    stops = ",".join(f"'{c}'" for c in stop_codons(table_id))
    code = ",".join(f"('{codon}','{aa}')" for codon, aa in genetic_code(table_id).items())
    return f"""{DNA},{STRANDS},
code(codon, aa) AS (VALUES {code}),
framed AS (
  SELECT seq_id, strand, frame, regexp_extract_all(substr(bases, frame), '...') AS codons
  FROM strands, (VALUES (1),(2),(3)) AS f(frame)
),
codons AS (
  SELECT seq_id, strand, frame, unnest(codons) AS codon, generate_subscripts(codons, 1) AS i FROM framed
),
marked AS (
  SELECT *, coalesce(sum(CAST(codon IN ({stops}) AS INT)) OVER (
    PARTITION BY seq_id, strand, frame ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM codons
),
islands AS (
  SELECT seq_id AS parent_id, strand, frame, run,
         CAST(min(i) * 3 - 3 + frame AS BIGINT) AS "start", CAST(max(i) * 3 + frame - 1 AS BIGINT) AS "end",
         string_agg(codon, '' ORDER BY i) AS nt_sequence,
         string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS aa_sequence
  FROM marked LEFT JOIN code USING (codon)
  GROUP BY seq_id, strand, frame, run HAVING count(*) * 3 >= {min_nt}
),
orfs AS (
  SELECT parent_id, 'orf' || row_number() OVER (PARTITION BY parent_id ORDER BY strand, frame, "start") AS orf_id,
         "start", "end", strand, CAST(frame AS BIGINT) AS frame, nt_sequence, aa_sequence,
         contains(aa_sequence, 'M') AS has_start_codon, contains(aa_sequence, '*') AS has_stop_codon,
         regexp_replace(aa_sequence, '[*]$', '') AS protein_aa,
         length(regexp_replace(aa_sequence, '[*]$', '')) AS aa_length
  FROM islands
)"""


ORFS = orfs_cte()

CDS = """
cds AS (
  SELECT parent_id, "start" - 1 AS "start", "end", strand, substr(aa_sequence, 6) AS protein_sequence
  FROM orfs WHERE parent_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)
    AND substr(aa_sequence, 6) <> ''
)"""

MATCHED = f"""{ORFS},{CDS},
matched AS (
  SELECT o.*, right(rtrim(aa_sequence, '*'), 10) IN
    (SELECT right(rtrim(protein_sequence, '*'), 10) FROM cds) AS in_genbank
  FROM orfs o
)"""

SCORED = f"""{MATCHED},
scored AS (
  SELECT parent_id, orf_id, aa_length, CAST(in_genbank AS INT) AS label,
         CAST(aa_length AS DOUBLE) / (CAST(aa_length AS DOUBLE) + CAST(60 AS DOUBLE)) AS probability
  FROM matched
),
predicted AS (SELECT *, CAST(probability > 0.5 AS INT) AS predicted_label FROM scored)"""


def entropy_of(relation: str, key: str, text: str) -> str:
    """CTEs ``h(key, entropy)`` over a text column, 0 for an empty text."""
    return f"""
symbols AS (SELECT {key}, unnest(string_split({text}, '')) AS symbol FROM {relation} WHERE {text} <> ''),
counts AS (SELECT {key}, symbol, count(*) AS n FROM symbols GROUP BY {key}, symbol),
shares AS (SELECT {key}, n / sum(n) OVER (PARTITION BY {key}) AS p FROM counts),
bits AS (SELECT {key}, -sum(p * log2(p)) AS entropy FROM shares GROUP BY {key}),
h AS (SELECT r.{key}, coalesce(entropy, 0) + 0.0 AS entropy FROM {relation} r LEFT JOIN bits USING ({key}))"""


def orf_entropy(name: str, relation: str, text: str) -> str:
    """CTE ``name(parent_id, orf_id, entropy)`` of one level of the ORFs."""
    return f"""
{name}_counts AS (
  SELECT parent_id, orf_id, symbol, count(*) AS n
  FROM (SELECT parent_id, orf_id, unnest(string_split({text}, '')) AS symbol FROM {relation} WHERE {text} <> '')
  GROUP BY ALL
),
{name} AS (
  SELECT r.parent_id, r.orf_id, coalesce(entropy, 0) AS entropy
  FROM {relation} r LEFT JOIN (
    SELECT parent_id, orf_id, -sum(p * log2(p)) AS entropy
    FROM (SELECT parent_id, orf_id, n / sum(n) OVER (PARTITION BY parent_id, orf_id) AS p FROM {name}_counts)
    GROUP BY ALL
  ) USING (parent_id, orf_id)
)"""


FEATURES = f"""{MATCHED},
encoded AS (SELECT *, translate(protein_aa, '{STAND_IN_FROM}', '{STAND_IN_TO}') AS three_di FROM matched),
{orf_entropy("h_dna", "encoded", "nt_sequence")},
{orf_entropy("h_protein", "encoded", "protein_aa")},
{orf_entropy("h_three_di", "encoded", "three_di")},
features AS (
  SELECT e.*, d.entropy AS dna_entropy, p.entropy AS protein_entropy, t.entropy AS three_di_entropy
  FROM encoded e JOIN h_dna d USING (parent_id, orf_id) JOIN h_protein p USING (parent_id, orf_id)
  JOIN h_three_di t USING (parent_id, orf_id)
)"""

ORF_ROW = """parent_id, orf_id, "start", "end", strand, frame, md5(nt_sequence) AS nt_md5, md5(aa_sequence) AS aa_md5"""
