"""The queries of the corpus operators: each runs over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sequenza.llm import digest, language, lines, mixing, packing, quality, sentencepieces, simhash, suffix, tokencount
from sequenza.llm.common import read
from sequenza.llm.tokencount import PIECE_MODEL, TOKENIZERS, vocabulary


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, language and margin of every document."""
    return language.identify(read(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word ranges that every document repeats from itself or an earlier one."""
    return suffix.repeated_passages(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of lines that every document repeats from itself or an earlier one."""
    return lines.repeated_runs(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Words and greedy longest-match tokens of every document."""
    return tokencount.token_counts(read(spark, sf_dir, "documents"), *vocabulary(tokenizers))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly score of every document, and whether it is rejected."""
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group_id) of every document that has near copies; group_id is the least doc_id of the group."""
    return simhash.near_duplicate_groups(read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The pieces of every document, whether they decode to it, and whether the library gives the same."""
    return sentencepieces.encoded(read(spark, sf_dir, "documents"), f"{tokenizers}/{PIECE_MODEL}")


def op8_packing(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The length bucket and the batch of every document, by its tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary=vocabulary(tokenizers))


def packing_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by words between white space, which SQL can count."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest and the class of every document, how many documents are near it, the nearest other class, and the benchmark item near it."""
    return digest.fingerprints(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits per byte of every document, by the model of all documents."""
    return mixing.bits_per_byte(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed batches that the corpus pipeline makes of all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_suffix_array_dedup, op3_line_dedup, op4_token_counts, op5_quality_rules, op6_simhash_near_dedup, op7_sentencepiece, op8_packing, packing_by_words, op9_document_fingerprints, op10_lm_scoring, pipeline)}


_SOLID = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH word AS (
  SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) - 1 AS k FROM (SELECT doc_id, {_SOLID} AS p FROM documents)
), win AS (
  SELECT doc_id, k, string_agg(w, ' ') OVER o AS t, count(*) OVER o AS n
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), placed AS (
  SELECT doc_id, k, row_number() OVER o AS r, first_value(doc_id) OVER o AS source FROM win WHERE n = 50 WINDOW o AS (PARTITION BY t ORDER BY doc_id, k)
), again AS (
  SELECT *, CASE WHEN k <= max(k + 50) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM placed WHERE r > 1
), run AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM again
)
SELECT doc_id, CAST(min(k) AS INT) AS first_word, CAST(max(k) + 49 AS INT) AS last_word, min(source) AS source_doc_id FROM run GROUP BY doc_id, run
"""
#: The dynamic programme as a step for each bucket over all pairs of lengths.
OP8_SQL = f"""
WITH RECURSIVE size AS (
  SELECT doc_id, CAST(len({_SOLID}) AS BIGINT) AS n FROM documents
), hist AS (
  SELECT row_number() OVER (ORDER BY n) AS j, n AS upper, sum(count(*)) OVER (ORDER BY n) AS c, sum(n * count(*)) OVER (ORDER BY n) AS s FROM size WHERE n > 0 GROUP BY n
), dp AS (
  SELECT 1 AS step, j, CAST(upper * c - s AS BIGINT) AS cost, [upper] AS uppers FROM hist
  UNION ALL
  SELECT step, j, best.cost, best.uppers FROM (
    SELECT d.step + 1 AS step, b.j, arg_min({{'cost': CAST(d.cost + b.upper * (b.c - a.c) - (b.s - a.s) AS BIGINT), 'uppers': list_append(d.uppers, b.upper)}}, d.cost + b.upper * (b.c - a.c) - (b.s - a.s)) AS best
    FROM dp d JOIN hist a ON a.j = d.j JOIN hist b ON b.j > a.j WHERE d.step < {packing.BUCKETS} GROUP BY d.step, b.j)
), best AS (
  SELECT arg_min(uppers, (cost, step)) AS uppers FROM dp WHERE j = (SELECT max(j) FROM hist)
), upper AS (
  SELECT doc_id, n, CASE WHEN n > 0 THEN list_min(list_filter((SELECT uppers FROM best), lambda u: u >= n)) END AS padded FROM size
)
SELECT doc_id, n AS n_tokens, padded AS padded_length, (row_number() OVER (PARTITION BY padded ORDER BY doc_id, n) - 1) // greatest(1, {packing.BUDGET} // padded) AS batch FROM upper
"""
OP3_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents
), solid AS (
  SELECT doc_id, n, line FROM line WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
), size AS (
  SELECT doc_id, n AS top, CASE WHEN w >= 8 THEN 1 WHEN w + lead(w) OVER o >= 8 THEN 2 ELSE 3 END AS size, line, lead(line) OVER o AS line2, lead(line, 2) OVER o AS line3, lead(n) OVER o AS n2, lead(n, 2) OVER o AS n3
  FROM (SELECT *, len(list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM solid) WINDOW o AS (PARTITION BY doc_id ORDER BY n)
), win AS (
  SELECT doc_id, top, CASE size WHEN 1 THEN top WHEN 2 THEN n2 ELSE n3 END AS bottom, CASE size WHEN 1 THEN line WHEN 2 THEN line || chr(10) || line2 ELSE line || chr(10) || line2 || chr(10) || line3 END AS lines FROM size
), again AS (
  SELECT doc_id, top, bottom FROM (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, top) AS r FROM win WHERE bottom IS NOT NULL) WHERE r > 1
), marked AS (
  SELECT *, CASE WHEN top <= max(bottom) OVER (PARTITION BY doc_id ORDER BY top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS begins FROM again
), run AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY top ROWS UNBOUNDED PRECEDING) AS run FROM marked
)
SELECT doc_id, CAST(min(top) AS INT) AS first_line, CAST(max(bottom) AS INT) AS last_line FROM run GROUP BY doc_id, run
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "packing_by_words": OP8_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
