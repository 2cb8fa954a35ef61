"""One query for each operator over its whole table, and DuckDB's SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, embedding_dedup, html_main, near_dedup, packing, pii, quality, resampling, substring_dedup, tokens, topk, toxicity
from .common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_file_digest(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), passage=substring_dedup.PASSAGE)


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that op6 goes by first of all, on their own."""
    return substring_dedup.repeated_lines(table(spark, sf_dir, "documents")).drop("row")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_decontamination, op3_pii, op4_toxicity, op5_packing, op6_repeated_spans, op7_html_main_text, op8_quality, op9_near_duplicates, op10_exact_top_k, op11_importance_resampling, op12_collocations, op13_embedding_near_duplicates, repeated_lines)}

ORACLE_SQL = {
    "op9_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN w ELSE [] END AS s
  FROM words
), one AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op11_importance_resampling": r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || list_transform(range(8), lambda z: CAST(0 AS BIGINT)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT NULL, false, text FROM benchmark
), lists AS (
  SELECT doc_id, own, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM texts
), one AS (SELECT doc_id, own, unnest(w) AS w FROM lists),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM one)),
hashed AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda i: CAST(CAST('0x' || substr(x, i, 2) AS INTEGER) AS BIGINT)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table
), counts AS (SELECT bucket, count_if(own) AS s, count_if(NOT own) AS t FROM one JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT CAST(sum(s) AS DOUBLE) AS n_s, CAST(sum(t) AS DOUBLE) AS n_t FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (n_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (n_t + 10000)))) AS BIGINT) AS gain FROM counts, totals),
weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM one JOIN hashed USING (w) JOIN gains USING (bucket) WHERE own GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM lists LEFT JOIN weights USING (doc_id) WHERE own
), placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count_if(n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM placed
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
placed AS (SELECT lang, z, x.w AS w, x.i AS i FROM (SELECT lang, z, unnest(list_transform(w, lambda v, i: {'w': v, 'i': i})) AS x FROM (SELECT lang, w, row_number() OVER () AS z FROM lists))),
runs AS (
  SELECT lang, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3, w || ' ' || w2 || ' ' || w3 || ' ' || w4]) AS phrase
  FROM (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM placed WINDOW o AS (PARTITION BY z ORDER BY i))
),
f AS MATERIALIZED (SELECT lang, string_split(phrase, ' ') AS p, phrase, a FROM (SELECT lang, phrase, count(*) AS a FROM runs WHERE phrase IS NOT NULL GROUP BY lang, phrase HAVING count(*) >= 30)),
parts AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(p[1:k], ' ') AS first, array_to_string(p[k + 1:], ' ') AS rest FROM f, range(1, 4) z(k) WHERE k < len(p)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, 2000000::HUGEINT * c.a // (l.a + r.a) AS score
  FROM parts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
), least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
subs AS MATERIALIZED (SELECT lang, a, array_to_string(p[i:j], ' ') AS phrase FROM f, range(1, 4) s(i), range(2, 5) e(j) WHERE i < j AND j <= len(p) AND j - i + 1 < len(p)),
inside AS (SELECT DISTINCT c.lang, c.phrase FROM f c JOIN subs m ON m.lang = c.lang AND m.phrase = c.phrase WHERE 100::HUGEINT * m.a >= 80::HUGEINT * c.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM least ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op13_embedding_near_duplicates": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), lowest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN lowest USING (vec_id) LEFT JOIN counts USING (vec_id)
""",
    "repeated_lines": r"""
WITH pieces AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, x.i AS line, x.t AS t FROM (SELECT doc_id, unnest(list_transform(p, lambda v, i: {'i': i - 1, 't': v})) AS x FROM pieces)),
placed AS (SELECT doc_id, line, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(t) - 1 AS base, list_filter(string_split_regex(lower(t), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+'), lambda w: w <> '') AS w FROM lines),
ranked AS (SELECT *, row_number() OVER o AS place, first_value(doc_id) OVER o AS kept_doc_id, first_value(line) OVER o AS kept_line FROM placed WHERE len(w) > 0 WINDOW o AS (PARTITION BY w ORDER BY doc_id, line))
SELECT doc_id, line, CAST(base + length(t) - length(ltrim(t, chr(32) || chr(9) || chr(13))) AS BIGINT) AS start, CAST(base + length(rtrim(t, chr(32) || chr(9) || chr(13))) AS BIGINT) AS "end", CAST(len(w) AS BIGINT) AS n_words, kept_doc_id, kept_line FROM ranked WHERE place > 1
""",
}
