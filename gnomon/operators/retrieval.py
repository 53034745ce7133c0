"""Chunks, lexical and vector retrieval, fusion, and retrieval metrics, for batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.functions.storage import cut_lineage, spread
from gnomon.functions.text import tokenize


def chunk_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line that is not blank, with its place and where it starts (0-based)."""
    rows = docs.select(ident, F.posexplode(F.split(text, "\n")).alias("index", "chunk"))
    before = W.partitionBy(ident).orderBy("index").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("chunk") + 1).over(before), F.lit(0)))
    return rows.where(F.trim("chunk") != "").select(ident, F.col("index").cast("long"), F.col("start").cast("long"), F.length("chunk").cast("long").alias("length"), "chunk")


def postings(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, term, tf, length (tokens of the document)."""
    tokens = spread(docs.select(ident, text)).select(ident, tokenize(F.col(text)).alias("tokens"))
    return tokens.select(ident, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(ident, "term", "length").agg(F.count("*").alias("tf"))


def term_index(docs: DataFrame, terms: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, term, tf, length: postings of the terms given (term), and one row with the empty term for each document.

    Texts are cut into tokens once; only tokens that are asked for go on, counted before they are shuffled. The table is
    written, since scoring reads it for the sizes, for the frequencies and for the postings.
    """
    tokens = spread(docs.select(ident, text)).select(ident, F.regexp_extract_all(F.col(text), F.lit("[a-zA-Z0-9]+"), F.lit(0)).alias("tokens"))
    rows = tokens.select(ident, F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("tokens", F.array().cast("array<string>")))).alias("term")).withColumn("term", F.lower("term"))
    asked = terms.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    return cut_lineage(rows.join(asked, "term", "left_semi").groupBy(ident, "length", "term").agg(F.count("*").alias("tf")))


def bm25(docs: DataFrame, queries: DataFrame, top: int = 10, k1: float = 1.5, b: float = 0.75, ident: str = "doc_id", query: str = "query_id") -> DataFrame:
    """query, ident, rank, score: a term that a query repeats counts as often; ties go to the smaller id. Scores are ranked
    as they are shown, to six digits, so that ties do not depend on the order of sums."""
    asked = postings(queries.select(F.col(query), F.col("text")), query).select(query, "term", F.col("tf").alias("asked"))
    index = term_index(docs, asked, ident)
    stats = index.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    mine = spread(index.where("term <> ''"))
    n, mean, tf = F.col("n"), F.col("mean"), F.col("tf")
    # The query side carries all that hangs on the term alone, so that postings meet one small table.
    weight = F.col("asked") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (k1 + 1)
    side = asked.join(mine.groupBy("term").agg(F.count("*").alias("df")), "term").crossJoin(F.broadcast(stats)).select(query, "term", "mean", weight.alias("weight"))
    part = F.col("weight") * tf / (tf + k1 * (1 - b + b * F.col("length") / mean))
    scored = mine.join(side, "term").groupBy(query, ident).agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), ident))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(query, ident, "rank", "score")


def containing(docs: DataFrame, items: DataFrame, ident: str = "doc_id", item: str = "query_id", grams: int = 3) -> DataFrame:
    """item, ident: documents whose text holds an item's text.

    Whole words in the middle of an item stand as words in every text that holds it, so texts meet items by the hash of
    `grams` such words, and only pairs that share it are searched. Items of too few words, which can have no such key, meet
    every text.
    """
    split = lambda c: F.split(c, r"\s+")
    wanted = items.where("text is not null").select(F.col(item), F.col("text").alias("needle"), split("text").alias("w"))
    word = lambda at: F.xxhash64(*[F.element_at("w", at + F.lit(j)) for j in range(grams)])
    long = wanted.where(F.size("w") >= grams + 2).select(item, "needle", word(F.floor((F.size("w") - grams) / 2).cast("int") + 1).alias("key"))
    places = F.when(F.size("w") >= grams, F.sequence(F.lit(1), F.size("w") - grams + 1)).otherwise(F.array().cast("array<int>"))
    rows = spread(docs.where("text is not null").select(F.col(ident), "text")).select(F.col(ident), F.col("text").alias("hay"), split("text").alias("w"))
    keyed = rows.select(ident, "hay", "w", F.explode(F.array_distinct(F.transform(places, lambda i: word(i)))).alias("key"))
    found = keyed.join(long, "key").where(F.col("hay").contains(F.col("needle"))).select(item, ident)
    short = wanted.where(F.size("w") < grams + 2).select(item, "needle")
    return found.unionByName(rows.select(ident, "hay").join(short, F.col("hay").contains(F.col("needle"))).select(item, ident)).distinct()


def embed(docs: DataFrame, ident: str = "doc_id", dims: int = 256, text: str = "text") -> DataFrame:
    """ident, vector: signed feature hashing of tokens to length 1; zeros for a text without tokens."""
    rows = spread(docs.select(ident, text)).select(ident, F.explode(tokenize(F.col(text))).alias("t")).groupBy(ident, "t").agg(F.count("*").alias("c"))
    h = F.md5(F.col("t").cast("binary"))
    number = F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = rows.groupBy(ident, (number % dims).cast("int").alias("dim")).agg(F.sum(sign * F.col("c")).cast("double").alias("s"))
    maps = sums.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("dim", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    value = lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0)
    return docs.select(ident).join(maps, ident, "left").select(ident, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).alias("vector")).withColumn("vector", F.transform("vector", lambda v: F.coalesce(v, F.lit(0.0))))


def hash_embedding(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, dim, weight: signed feature hashing of tokens into 256 places, to length 1, without zeros."""
    rows = spread(docs.select(ident, text)).select(ident, F.explode(tokenize(F.col(text))).alias("t")).groupBy(ident, "t").agg(F.count("*").alias("c"))
    h = F.md5(F.col("t").cast("binary"))
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    rows = rows.groupBy(ident, F.conv(F.substring(h, 1, 2), 16, 10).cast("long").alias("dim")).agg(F.sum(sign * F.col("c")).alias("s")).where("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(W.partitionBy(ident)))
    return rows.select(ident, "dim", F.round(F.col("s") / norm, 6).alias("weight"))


def cosine_top(vectors: DataFrame, queries: DataFrame, top: int = 10, block_rows: int = 8192, chunk_rows: int = 2048) -> DataFrame:
    """query_id, vec_id, rank, score: exact cosine of every query (query_id, q) and vector (vec_id, embedding).

    Vectors are dealt into blocks and queries into chunks, both of bounded size; every chunk meets every block, and only a
    block's best `top` of each query become rows. Null and zero vectors, and those of another length, have score 0.
    """
    blocks, chunks = max(1, -(-vectors.count() // block_rows)), max(1, -(-queries.count() // chunk_rows))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), upto(chunks).alias("chunk"))
    right = queries.select(F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"), F.pmod(F.xxhash64("query_id", "q", F.lit(5)), F.lit(chunks)).cast("int").alias("chunk"), upto(blocks).alias("block"))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(_best_cosines(top), f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("query_id", "vec_id", "rank", "score")


def _best_cosines(top: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("id")
            lists, wanted = ([x if x and None not in x else [] for x in t.column("v").to_pylist()] for t in (rows, asked))
            ids, names = rows.column("id").to_pylist(), asked.column("id").to_pylist()
            for size in {len(q) for q in wanted}:
                v = np.array([x if len(x) == size else [0.0] * size for x in lists], np.float64).reshape(len(lists), size)
                mine = [i for i, q in enumerate(wanted) if len(q) == size]
                for i in range(0, len(mine), 256):
                    q = np.array([wanted[j] for j in mine[i : i + 256]], np.float64).reshape(len(mine[i : i + 256]), size)
                    norm = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
                    score = np.divide(q @ v.T, norm, out=np.zeros_like(norm), where=~(norm <= 0))
                    score = np.copysign(np.floor(np.abs(score) * 1e6 + 0.5) / 1e6, score) + 0.0  # half up, as SQL rounds
                    key = np.where(np.isnan(score), np.inf, score)
                    for j, k, s in zip(mine[i : i + 256], key, score, strict=True):
                        some = np.flatnonzero(k >= np.partition(k, max(0, len(k) - top))[max(0, len(k) - top)])
                        out += [(names[j], ids[x], float(s[x])) for x in some[np.argsort(-k[some], kind="stable")[:top]]]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), cols, (asked.schema.field("id").type, rows.schema.field("id").type, pa.float64()), strict=True)})

    return run


def reciprocal_rank_fusion(ranked: DataFrame, k: int = 60, weights: dict[str, float] | None = None, contributions: bool = False) -> DataFrame:
    """query_id, object_id, score: of rows (query_id, method, object_id, rank from 1) the sum of weight / (k + rank - 1).

    contributions: also a map from each method to its share.
    """
    weight = F.lit(1.0)
    for method, w in (weights or {}).items():
        weight = F.when(F.col("method") == method, F.lit(float(w))).otherwise(weight)
    rows = ranked.withColumn("part", weight / (k + F.col("rank") - 1))
    if not contributions:
        return rows.groupBy("query_id", "object_id").agg(F.round(F.sum("part"), 6).alias("score"))
    one = rows.groupBy("query_id", "object_id", "method").agg(F.sum("part").alias("part"))
    return one.groupBy("query_id", "object_id").agg(F.sum("part").alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "part")))).alias("contributions"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5, of_k: bool = False) -> DataFrame:
    """query_id, recall, precision (of the rows returned, or with of_k of k), reciprocal_rank, ndcg, average_precision at k."""
    rows = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "object_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    hits = F.sum("hit").over(W.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("at", F.when(F.col("hit") == 1, hits / F.col("rank")))
    got = rows.groupBy("query_id").agg(F.sum("hit").alias("hits"), F.count("*").alias("returned"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("at").alias("ap"))
    many = relevant.groupBy("query_id").agg(F.count("*").alias("many"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("many", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + F.lit(1.0)))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return many.join(got, "query_id", "left").select(
        "query_id",
        zero(F.col("hits") / F.col("many")).alias("recall"),
        zero(F.col("hits") / (F.lit(k) if of_k else F.col("returned"))).alias("precision"),
        zero(1.0 / F.col("first")).alias("reciprocal_rank"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
        zero(F.col("ap") / F.col("many")).alias("average_precision"),
    )


def chunk_overlap(chunks: DataFrame, documents: DataFrame, overlap: int) -> DataFrame:
    """Chunks (doc_id, index, start, length, chunk) that begin `overlap` characters before the end of the one before."""
    end = F.col("start") + F.col("length")
    before = F.lag(end).over(W.partitionBy("doc_id").orderBy("index"))
    rows = chunks.select("doc_id", "index", F.greatest(F.lit(0), F.coalesce(before - overlap, "start")).alias("start"), end.alias("end"))
    joined = rows.join(documents.select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "index", "start", "end", F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("chunk"))
