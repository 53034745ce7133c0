"""Connected components of a graph given as links, by alternating large and small stars.

Every round each node sends the smallest of its neighbours to the others, so chains shorten by halves. Rounds are
written to the shared folder, so lineage stays short and nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm import common as C

_SALTS = 8


def _stars(both: DataFrame, large: bool) -> DataFrame:
    """both: u, v. Large: from each u its larger neighbours to the least of all; small: from each u its smaller ones and itself."""
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("top"))
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    dealt = (near.where("v > u") if large else near).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)).cast("int"))
    out = dealt.join(spread, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every node of links (u, v); nodes without links are not in it."""
    spark = links.sparkSession
    folder = C.shared_dir(spark)
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = C.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{folder}/0")
    sign = None
    for n in range(1, 100):
        now = C.written(_stars(both(_stars(both(now), True)), False), f"{folder}/{n}")
        last, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == sign:
            break
    else:
        raise RuntimeError("components still change")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
