"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codonlake.llm import hamming, html, language, mixing, phrases, pieces, quality, secrets, simhash, spelling, subwords, suffixes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_table(_table(spark, sf_dir, "documents"))


@_query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


@_query
def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(_table(spark, sf_dir, "documents"))


@_query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).drop("copies")


@_query
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


@_query
def op7_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_table(_table(spark, sf_dir, "documents"))


@_query
def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op9_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_table(_table(spark, sf_dir, "documents"))


@_query
def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(_table(spark, sf_dir, "pages"))


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


@_query
def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.round_trip_digests(_table(spark, sf_dir, "documents"))


@_query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


#: Pages by payload: the largest page_id of equal payloads is the response.
ORACLE["op6_warc_revisits"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest
  FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM m"""

#: Sign codes, and the ten nearest by Hamming distance, then id, of every vector whose id is divisible by 50.
ORACLE["op3_hamming_top_k"] = """
WITH bits AS (
  SELECT vec_id, unnest(range(64)) AS i, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), codes AS (
  SELECT vec_id AS id, string_agg(CASE WHEN coalesce(embedding[i + 1], 0) > 0 THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS code
  FROM bits GROUP BY vec_id
), pairs AS (
  SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code))::INT AS distance
  FROM codes q, codes c WHERE q.id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM pairs
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10"""


#: All phrases of up to five words by language, counted; the weakest cut of each, and the best 2000.
ORACLE["op13_phrase_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), spelled AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM spelled WHERE len(w) > 0
), grams AS (
  SELECT lang, list_slice(w, i, i + m - 1) AS p FROM places, range(1, 6) t(m) WHERE i + m - 1 <= len(w)
), f AS MATERIALIZED (SELECT lang, p, len(p) AS m, count(*) AS c FROM grams GROUP BY ALL
), totals AS MATERIALIZED (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), common AS MATERIALIZED (SELECT lang, p, m, c FROM f WHERE c >= 100
), candidates AS MATERIALIZED (SELECT lang, p, m, c AS a FROM common WHERE m > 1
), parts AS (
  SELECT lang, a, list_slice(p, i, j) AS p
  FROM candidates, range(1, 6) x(i), range(1, 6) y(j) WHERE i < j AND j <= m AND j - i + 1 < m
), inner_phrases AS MATERIALIZED (
  SELECT DISTINCT s.lang, s.p FROM parts s JOIN candidates c ON c.lang = s.lang AND c.p = s.p AND 100 * s.a >= 100 * c.a
), halves AS MATERIALIZED (
  SELECT lang, p, a, k, list_slice(p, 1, k) AS lp, list_slice(p, k + 1, m) AS rp
  FROM candidates ANTI JOIN inner_phrases USING (lang, p), range(1, 5) t(k) WHERE k < m
), cuts AS (
  SELECT h.lang, h.p, a, k, l.c AS l, r.c AS r, n, (1000::HUGEINT * a * n // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM halves h JOIN totals t ON t.lang = h.lang
  JOIN common l ON l.lang = h.lang AND l.p = lp JOIN common r ON r.lang = h.lang AND r.p = rp
), weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM cuts
), ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM weakest WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
