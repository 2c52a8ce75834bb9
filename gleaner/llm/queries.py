"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .common import read
from .decontaminate import find_leaks
from .line_dedup import dedup_lines
from .lm_scoring import score_texts
from .mixing import mix_sources
from .near_dedup import near_classes
from .permutation_index import nearest
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import fit, held_out, score_toxicity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), min_words=1)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    done = score_toxicity(docs, model, keep=["doc_id"])
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("id").alias("doc_id"), "class_id", "class_size")


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix_sources(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         coalesce('=' || role, '-') || chr(31) || coalesce('=' || text, '-') || chr(30) AS e,
         '<|' || replace(coalesce(role, 'none'), '<|', '<||') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<||') || '<|end|>' || chr(10) AS r
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n_turns, md5(string_agg(e, '' ORDER BY i)) AS whole, string_agg(r, '' ORDER BY i) AS rendered FROM t GROUP BY conv_id
), p AS (
  SELECT conv_id, i, md5(string_agg(e, '') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS whole FROM t
), inside AS (
  SELECT DISTINCT p.whole FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id WHERE i < n_turns
), d AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_equal, whole FROM c GROUP BY whole
)
SELECT c.conv_id, n_turns, n_equal, rendered FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.whole = d.whole
WHERE c.whole NOT IN (SELECT whole FROM inside)
"""

OP3_SQL = r"""
WITH lines AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), each AS (
  SELECT rid, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM lines
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
), repeated AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT rid, keyed.doc_id, i, line, repeated.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM keep AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT rid, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)
), twice AS (
  SELECT s FROM w GROUP BY s HAVING count(*) > 1
), hit AS (
  SELECT rid, i FROM w SEMI JOIN twice USING (s)
), p AS (
  SELECT rid, i, ws[i] AS word FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), m AS (
  SELECT p.rid, p.i, word, max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.rid ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM p LEFT JOIN hit ON p.rid = hit.rid AND p.i = hit.i
), k AS (
  SELECT rid, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY rid
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('=mix-1' || chr(31) || coalesce('=' || doc_id::VARCHAR, '-') || chr(31) || '=' || md5(coalesce(text, chr(0)))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place, source_size * 3.0::DOUBLE AS cap FROM s
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM r
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, place, source_size, least(cap, max(level) OVER () * weight) AS target FROM l
), q AS (
  SELECT d.*, place, source_size, target, row_number() OVER () AS rid,
         sum(size) OVER (PARTITION BY place ORDER BY h, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT rid, place, size, (p * source_size + cum) / target AS f FROM q, (SELECT unnest([0, 1, 2]) AS p)
  WHERE target > 0 AND size > 0 AND p * source_size + cum - size < target
), o AS (
  SELECT rid, size, sum(size) OVER (ORDER BY f, place ROWS UNBOUNDED PRECEDING) AS upto FROM c
), k AS (
  SELECT rid, sum(size)::BIGINT AS taken FROM o WHERE upto <= (SELECT sum(size) FROM d) GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_lm_scores": op9_lm_scores,
    "op10_source_mix": op10_source_mix,
}

SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op3_line_dedup": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op10_source_mix": OP10_SQL}
