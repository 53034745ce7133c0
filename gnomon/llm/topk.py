"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks of bounded size, and the queries, a stated set, into chunks; every chunk meets every
block. In a block each dimension has a list of its vectors sorted by that component. For a query the lists are read
from their better ends in growing steps; every vector met is scored in full; the components where the lists stand give
the best score that a vector not yet met could have. A query stops when that bound is below its kth score: at an equal
bound a vector with a smaller id could still take the place. The blocks' winners, k for each query at most, meet in a
last ranking.

Components become floor(scale * x), x as double, and scores are integers. Where one could reach 2**53 all of them are worked
out with whole numbers of any size instead of doubles; a score beyond 64 bits is an error.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows without an id take no part. Vectors are compared with
those of the same length only. Rows with the query's id are its own and no candidates; other repeated rows each count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.llm import common as C

K, SCALE = 5, 256
BLOCK_ROWS, CHUNK_ROWS = 8192, 2048
_OUT = "query_id long, query_key long, vec_id long, score long"


class Lists:
    """The sorted lists of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, wide: bool = False):
        by = np.argsort(ids, kind="stable")
        self.kind = object if wide else np.float64
        self.ids, self.vectors = ids[by], np.ascontiguousarray(vectors[by].astype(self.kind))
        self.order = np.argsort(self.vectors.T, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)

    def search(self, query: np.ndarray, own: int, k: int, step: int = 32) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the best k, best first, and how many vectors were scored."""
        n = len(self.ids)
        query = query.astype(self.kind)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        best, scores = np.empty(0, np.int64), np.empty(0, self.kind)
        met, at, seen = np.zeros(n, bool), 0, 0
        while at < n:
            to = n if not len(up) + len(down) else min(n, max(step, 2 * at))
            new = np.zeros(n, bool)
            if len(up) + len(down):
                new[self.order[up, n - to : n - at].ravel()] = True
                new[self.order[down, at:to].ravel()] = True
            else:
                new[:] = True
            new &= ~met
            met |= new
            found = np.flatnonzero(new)
            seen += len(found)
            found = found[self.ids[found] != own]
            best = np.concatenate([best, found])
            scores = np.concatenate([scores, self.vectors[found] @ query])
            # Places are in the order of ids.
            keep = np.lexsort((best, -scores))[:k] if self.kind is not object else np.array(sorted(range(len(best)), key=lambda i: (-scores[i], best[i]))[:k], np.int64)
            best, scores, at = best[keep], scores[keep], to
            bound = query[up] @ self.sorted[up, n - at] + query[down] @ self.sorted[down, at - 1]
            if len(best) == k and bound < scores[-1]:
                break
        return best, scores, seen


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, ident: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: of every query row the k best other rows, ties to the smaller id."""
    x = F.col(embedding)
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    base = vectors.where(sound & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("v"), is_query.alias("asks")).withColumn("dim", F.size("v"))
    # A query null for whether it asks does not ask.
    n, asks, most = base.agg(F.count("*"), F.count_if("asks"), F.max(F.col("dim") * F.pow(F.array_max(F.transform("v", lambda v: F.abs(v).cast("double"))), F.lit(2)))).first()
    wide = most is not None and most >= 2**53
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-(asks or 0) // chunk_rows))
    left = base.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = base.where("asks").select("id", "v").distinct().select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("query_key"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return C.rows(_OUT, [])
        matrix = lambda t: np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
        lists = Lists(np.array(rows.column("id")), matrix(rows), wide)
        out = [[], [], [], []]
        for ident, key, query in zip(queries.column("id").to_pylist(), queries.column("query_key").to_pylist(), matrix(queries), strict=True):
            best, scores, _ = lists.search(query, ident, k)
            for have, more in zip(out, ([ident] * len(best), [key] * len(best), lists.ids[best], scores.astype(np.int64)), strict=True):
                have.extend(more)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "query_key", "vec_id", "score"), out, strict=True)})

    key = ["dim", "block", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, _OUT)
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
