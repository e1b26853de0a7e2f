"""The queries of this package's operators over the provided tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphlane.llm import bpe, decontaminate, idfiles, langid, neardup, ppm, quality, repeats, secrets, toxicity
from graphlane.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.digests(table(spark, sf_dir, "documents"), vocabulary(), END_ID)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ppm_score, op2_line_quality, op3_language, op4_toxicity, op5_bpe, op6_decontaminate, op7_secrets, op8_near_duplicates, op9_repeats, op10_id_files, pipeline]
    return {f.__name__: f for f in own}


OP2_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM d
), wins AS (
  SELECT r, i, words[i] AS x, words[i + 1] AS y, words[i + 2] AS z FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), often3 AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM wins) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM often3, (VALUES (0), (1), (2)) AS t(k) GROUP BY r
), l AS (
  SELECT r, host, line, len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS n,
         trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS norm
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d)
), lw AS (SELECT * FROM l WHERE n > 0),
often AS (SELECT host, norm FROM lw GROUP BY host, norm HAVING count(DISTINCT r) > {quality.LINE_DOCS}),
by_doc AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (WHERE (host, norm) IN (SELECT (host, norm) FROM often)), 0) AS gone FROM lw GROUP BY r
), o AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN by_doc USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {quality.LEFT_SHARE} * n_words AS kept
FROM o
"""

OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)
), dw AS (
  SELECT r, i, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), hit AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, gram)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP8_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM d WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_quality": OP2_SQL, "op6_decontaminate": OP6_SQL, "op8_near_duplicates": OP8_SQL}
