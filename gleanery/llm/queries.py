"""The training-data queries: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .chat_format import preference_pairs, repeating_answers
from .collision_knn import collision_knn
from .common import documents
from .exact_dedup import exact_groups
from .license_scan import license_scan
from .line_dedup import line_dedup
from .packing import pack
from .simhash_dedup import simhash_groups
from .token_counts import token_counts
from .toxicity import toxicity, train


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_collision_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return collision_knn(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference_pairs(chosen, repeating_answers(chosen))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_collision_knn, op3_simhash, op4_chat_format, op5_license_scan,
        op6_packing, op7_bpe, op8_line_dedup, op9_exact_dedup, op10_toxicity,
    )
}

#: DuckDB SQL where SQL can express the operator.  Approximate search (2), XXH64
#: fingerprints (3), fuzzy matching (5), tokenizers (1, 6, 7) and a learnt model
#: (10) are tested against brute force, round trips and held-out rows instead.
ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": r"""
WITH t AS (SELECT DISTINCT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i,
        first(CASE WHEN role = 'assistant' THEN txt END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS answer FROM t WHERE conv_id IS NOT NULL),
b AS (SELECT *, CASE WHEN role = 'assistant' THEN answer ELSE txt END AS rtxt FROM c),
n AS (SELECT conv_id, coalesce(min(CASE WHEN txt <> rtxt THEN i END) - 1, count(*)) AS n FROM b GROUP BY conv_id),
r AS (SELECT b.*, n.n,
        '<|im_start|>' || role || chr(10) || txt || '<|im_end|>' || chr(10) AS cr,
        '<|im_start|>' || role || chr(10) || rtxt || '<|im_end|>' || chr(10) AS rr FROM b JOIN n USING (conv_id)),
o AS (SELECT *,
        sum(CASE WHEN i > n THEN length(cr) ELSE 0 END) OVER w AS cend,
        sum(CASE WHEN i > n THEN length(rr) ELSE 0 END) OVER w AS rend FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, any_value(n)::INTEGER AS n_prompt_turns,
  coalesce(string_agg(cr, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
  coalesce(string_agg(cr, '' ORDER BY i) FILTER (i > n), '') AS chosen,
  coalesce(string_agg((cend - length(txt) - 11)::BIGINT || ':' || cend::BIGINT, ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(rr, '' ORDER BY i) FILTER (i > n), '') AS rejected,
  coalesce(string_agg((rend - length(rtxt) - 11)::BIGINT || ':' || rend::BIGINT, ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS rejected_loss
FROM o GROUP BY conv_id""",
    "op8_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)""",
}
