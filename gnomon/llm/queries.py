"""The queries of this folder, with the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import common as C


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.toxicity import score_documents, train

    docs, held = C.table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs, C.table(spark, sf_dir, "labels"), allowed=~held)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.token_files import read_token_files, write_token_files

    folder = f"{C.shared_dir(spark)}/ids"
    manifest = write_token_files(C.table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.json", 2)
    return read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.substring_dedup import remove_repeated_windows

    return remove_repeated_windows(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.license_scan import notices, scan

    return scan(C.table(spark, sf_dir, "documents"), notices(spark))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.jaccard_join import jaccard_groups

    return jaccard_groups(C.table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.packing import pack

    return pack(C.table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.warc import read_warc, write_warc

    folder = f"{C.shared_dir(spark)}/warc"
    index = write_warc(C.table(spark, sf_dir, "pages"), folder)
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.decontaminate import contaminated

    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.topk import top_k

    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.llm.suffix_dedup import remove_repeated_bytes

    return remove_repeated_bytes(C.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_token_ids, op3_substring_dedup, op4_license_scan, op5_jaccard_join, op6_packing, op7_warc, op8_decontamination, op9_topk, op10_suffix_dedup)}

ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (g) WHERE doc_id > f),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, count(*) AS k, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> m THEN m END AS refers_to FROM q""",
    "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
