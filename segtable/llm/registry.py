"""Thin queries over the tables, one per operation, and their SQL where SQL can express them.

Each applies its operation to the whole table and derives the digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lines, lm, minhash, packing, rules, suffixes, superkmers, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sha(col: str, name: str):
    return F.sha2(F.col(col).cast("binary"), 256).alias(name)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.remove_repeated_bytes(_documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), _sha("kept", "kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove_repeated_words(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", _sha("kept", "kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(packing.word_counts(_documents(spark, sf_dir)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", _sha("kept", "kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", langid.remainder("doc_id", 5) == 0)
    return langid.predict(docs, langid.train(docs.where(~F.col("held_out")))).select("doc_id", (langid.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_documents(spark, sf_dir))


def op8_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_decode(_documents(spark, sf_dir), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), _sha("decoded", "decoded_sha256"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.judge_quality(_documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


OP1_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""

OP2_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
cut AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM docs),
keyed AS (SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
often AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP5_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(len(h) // 2 - 49)) AS s, h FROM docs WHERE len(h) >= 100),
keyed AS (SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS INTEGER), 100) AS k FROM starts),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS first FROM keyed) WHERE first < doc_id),
runs AS (SELECT doc_id, s, sum(CASE WHEN s > last + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS r
         FROM (SELECT doc_id, s, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -100) AS last FROM dup)),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS stop FROM spans GROUP BY doc_id),
pieces AS (SELECT doc_id, string_agg(substr(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) AS kept
           FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, CAST(2 * stop + 1 AS INTEGER)) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id) LEFT JOIN pieces USING (doc_id)
"""

OP6_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(len(w) - 19)) AS s, w FROM docs WHERE len(w) >= 20),
keyed AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS k FROM starts),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM keyed) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM dup),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_top_k, op2_line_dedup, op3_language_id, op4_near_dedup, op5_suffix_dedup, op6_substring_dedup, op7_best_fit_packing, op8_bpe_tokens, op9_lm_scores, op10_quality_rules)}
SQL = {"op1_top_k": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_suffix_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL}
