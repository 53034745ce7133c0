"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input.

toxicity: documents that the network scores at 0.3 or more go. ngram_jaccard: of each group of linked documents the one
with the smallest (id, MD5 of the text) stays. suffix_dedup: byte strings of 100 that stand earlier are cut out of the texts; a character
cut in two is dropped whole, and n_chars follows the text. decontamination: documents that hold a benchmark item go.
packing: what is left becomes sequences of 4096 ids; one row for each piece.

Defined cases: every row is a document of its own, whatever other rows share its id or have none; a null id is smaller
than all. Rows that are equal in all columns are one. Texts without words are linked with nothing and all stay in
ngram_jaccard; a null text is empty, and after suffix_dedup it is an empty one. Columns besides those of documents stay as they
are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import common as C
from gnomon.llm.decontaminate import contaminated
from gnomon.llm.jaccard_join import jaccard_groups
from gnomon.llm.packing import pack
from gnomon.llm.suffix_dedup import remove_repeated_bytes
from gnomon.llm.toxicity import score_documents, train

THRESHOLD = 0.3
TOKENIZER, END = "word_bpe_49k.json", 2


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs, C.table(spark, sf_dir, "labels"), allowed=~held)
    score = C.free_name(docs, "score")
    return score_documents(docs, model, into=score).where(F.col(score) < THRESHOLD).drop(score)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = C.free_name(docs, "row")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).withColumn(row, F.xxhash64(*docs.columns))
    groups = jaccard_groups(rows, ident=row).select(F.col("doc_id").alias(row), "component_id").distinct()
    named = rows.select(row, F.struct(F.coalesce("doc_id", F.lit(C.NULL_ID)), _digest("text"), row).alias("least")).join(groups, row)
    stays = named.groupBy("component_id").agg(F.min("least").alias("least")).select(F.col("least")[row].alias(row))
    return rows.join(stays, row, "left_semi").dropDuplicates([row]).select(docs.columns).unionByName(docs.where(~worded))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ident, digest, text, old = (C.free_name(docs, n) for n in ("cut_id", "cut_digest", "cut_text", "old_digest"))
    cut = remove_repeated_bytes(docs).select(F.col("doc_id").alias(ident), F.col("digest").alias(digest), F.col("kept_text").alias(text)).dropDuplicates([ident, digest])
    # The other columns meet the new texts without the old ones.
    rest = docs.withColumn(old, _digest("text")).drop("text", "n_chars")
    joined = rest.join(cut, rest["doc_id"].eqNullSafe(cut[ident]) & (rest[old] == cut[digest])).withColumns({"text": F.col(text), "n_chars": F.length(text).cast("long")})
    return joined.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.xxhash64(docs["doc_id"], docs["text"])
    found = contaminated(docs.select(row.alias("doc_id"), "text"), C.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id")).distinct()
    return docs.join(found, row == found["id"], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, TOKENIZER, END).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the network, so there is none; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = C.table(spark, sf_dir, "documents"), C.shared_dir(spark)
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
