"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

All windows of an item's size that share enough shingles of five words with it are made, wherever in the window these stand:
windows whose shared shingles weigh less than PERCENT hundredths of the item's cannot be similar. Windows are cut off at the
ends of a text. Each window comes from the first shingle in it that it shares, so it is made once.
Windows and items get a SimHash of 128 bits over their shingles, weighted by how often they stand there times their
length (a shingle weighs the characters that it has). Fingerprints are cut into RADIUS + 1 blocks: two that differ in at most
RADIUS bits agree in one block at least, so joining by block finds all pairs within the radius. A window is looked up among
the blocks of the items that it shares a shingle with: blocks of few bits, as this radius makes them, would otherwise pair
most windows with most items. Pairs within the radius are verified: the sum of smaller weights must be at least PERCENT
hundredths of the sum of larger ones.

RADIUS: pairs of similarity 0.8 differ in 24 bits in the mean and in 32 at most of 8,479 simulated ones, so 39 loses a
pair with a probability far below one in ten thousand.

All of it runs in DataFrame functions. Any number of items may be given (see native.found_places).

Defined cases: null or empty texts and items have no windows. Items of fewer than five words have one shingle of all
their words. Repeated rows and ids give the same rows once. Null ids of
documents are kept; items without id take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.llm import common as C
from gnomon.llm import native as V

N, PERCENT, RADIUS = 5, 80, 39
_BITS = 128


def _weights(df: DataFrame, keys: list[str], words: str, n: int) -> DataFrame:
    """keys, sh, weight: the shingles of an array of words (all words, where it has fewer than n)."""
    size = F.least(F.lit(n), F.size(words))
    rows = df.select(*keys, words, F.explode(F.sequence(F.lit(1), F.size(words) - size + 1)).alias("i"))
    rows = rows.select(*keys, F.concat_ws(" ", F.slice(words, F.col("i"), F.least(F.lit(n), F.size(words)))).alias("gram"))
    return rows.groupBy(*keys, "gram").agg((F.count("*") * F.first(F.length("gram"))).alias("weight"))


def _fingerprints(weights: DataFrame, key: str) -> DataFrame:
    """key, low, high (the bits of its fingerprint), total weight.

    One sum holds the weights of two bits of a hash, 32 places apart; a window's weight stays far below 2**31.
    """
    pair = 0x100000001
    sums = [F.sum(F.col("weight") * F.shiftrightunsigned(h, i).bitwiseAND(F.lit(pair))).alias(f"s{w}_{i}") for w, h in enumerate((F.xxhash64("gram"), F.xxhash64("gram", F.lit(1)))) for i in range(32)]

    def word(w: int) -> Column:
        out, total = F.lit(0).cast("long"), F.col("total")
        for i in range(32):
            s = F.col(f"s{w}_{i}")
            for half, bit in ((s.bitwiseAND(F.lit(0xFFFFFFFF)), 1 << i), (F.shiftrightunsigned(s, 32), 1 << (i + 32) if i < 31 else -(1 << 63))):
                out = out.bitwiseOR(F.when(2 * half > total, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return weights.groupBy(key).agg(*sums, F.sum("weight").alias("total")).select(key, "total", word(0).alias("low"), word(1).alias("high"))


def _blocks(radius: int) -> Column:
    """(block number, its bits) of a fingerprint, as an array to explode."""
    many = radius + 1
    edges = [_BITS * i // many for i in range(many + 1)]

    def cut(a: int, b: int) -> Column:
        part = lambda c, x, y: F.shiftrightunsigned(c, x).bitwiseAND(F.lit((1 << (y - x)) - 1)) if y > x else F.lit(0).cast("long")
        low, high = part("low", min(a, 64), min(b, 64)), part("high", max(a, 64) - 64, max(b, 64) - 64)
        return low.bitwiseOR(F.shiftleft(high, max(0, min(b, 64) - a)))

    return F.array(*[F.struct(F.lit(i).alias("block"), cut(a, b).alias("bits")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a])


def item_windows(docs: DataFrame, items: DataFrame, totals: DataFrame, n: int, percent: int, ident: str, text: str, folder: str) -> DataFrame:
    """doc_id, item_key, window: the windows of an item's size, cut off at the text's ends, that share shingles with the item
    which weigh `percent` hundredths of all of its own; no other window can be that similar.

    items: item_key, item_text; totals: item_key, total (weight). Of a text only the surroundings of shared shingles go on.
    """
    shingles = C.written(V.pattern_shingles(items, "item_key", "item_text", n).join(totals, "item_key"), f"{folder}/shingles")
    docs = docs.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    rows = V.found_places(docs, ["doc_id", "row"], "text", shingles)
    at, many = F.col("at"), F.col("many")
    low = F.greatest(F.lit(1), at + F.col("size") - many)
    near = F.slice("words", low, F.least(F.size("words"), at + many - 1) - low + 1)
    weight = F.length(F.concat_ws(" ", F.slice("words", at, F.col("size")))).cast("long")
    # The same shingle may stand in an item more than once.
    rows = rows.select("doc_id", "row", "item_key", "at", "size", "many", "total", low.alias("low"), near.alias("near"), weight.alias("weight")).dropDuplicates(["doc_id", "row", "item_key", "at"])
    # A window belongs to its first shared shingle. From there it must reach the one that makes up the weight needed: the
    # one before the first whose predecessors, from here on, weigh as much. Weights are in millionths of what is needed.
    key = ["doc_id", "row", "item_key"]
    order = W.partitionBy(*key).orderBy("at")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    scaled = lambda c: F.floor(c * F.lit(100_000_000.0) / (F.col("total") * percent)).cast("long")
    every = W.partitionBy(*key)
    rows = rows.withColumns({"before": scaled(before), "all": scaled(F.sum("weight").over(every)) + 1, "previous": F.lag("at").over(order), "end": F.max("at").over(every)})
    beyond = F.first("previous").over(W.partitionBy(*key).orderBy("before").rangeBetween(999_998, W.unboundedFollowing))
    rows = rows.withColumn("reach", F.coalesce(beyond, F.when(F.col("all") - F.col("before") >= 999_998, F.col("end")))).where("reach is not null")
    first = F.greatest(at + F.col("size") - many, F.coalesce(F.col("previous") + 1, at + F.col("size") - many), F.col("reach") + F.col("size") - many)
    rows = rows.withColumn("first", first).where(F.col("first") <= at)
    starts = rows.select("doc_id", "item_key", "near", "low", "many", F.explode(F.sequence("first", "at")).alias("start"))
    begin = F.greatest("start", F.lit(1))
    return starts.select("doc_id", "item_key", F.slice("near", begin - F.col("low") + 1, F.col("start") + F.col("many") - begin).alias("window"))


def contaminated(docs: DataFrame, items: DataFrame, n: int = N, percent: int = PERCENT, radius: int = RADIUS, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity: the best similarity of a window of the document with the item, of at least percent / 100."""
    folder = C.shared_dir(docs.sparkSession)
    listed = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("item_text"))
    listed = V.held(listed.withColumn("raw", V.word_list(F.col("item_text"))), "words", F.col("raw")).where(F.size("words") > 0)
    # Items of one text are looked for once; rows with one id and several texts stay apart.
    listed = C.written(listed.select("item_id", F.sha2(F.concat_ws(" ", "words"), 256).alias("item_key"), F.concat_ws(" ", "words").alias("item_text"), "words").dropDuplicates(["item_id", "item_key"]), f"{folder}/items")
    texts = listed.dropDuplicates(["item_key"])
    theirs = C.written(_weights(texts, ["item_key"], "words", n), f"{folder}/theirs")
    totals = theirs.groupBy("item_key").agg(F.sum("weight").alias("total"))
    windows = item_windows(docs, texts, totals, n, percent, ident, text, folder)
    # Copies of a window, within a document or in thousands, go on as one row. Written, so that texts are searched once.
    owners = windows.withColumn("key", F.sha2(F.concat_ws(" ", "window"), 256)).groupBy("doc_id", "item_key", "key").agg(F.first("window").alias("window"))
    owners = C.written(owners, f"{folder}/windows")
    distinct = owners.groupBy("key").agg(F.first("window").alias("window"))
    ours = C.written(_weights(distinct, ["key"], "window", n), f"{folder}/ours")
    # Written, so that the sums of all bits stay out of the plans that follow.
    a = C.written(_fingerprints(ours, "key"), f"{folder}/prints").join(owners.select("key", "item_key").distinct(), "key")
    b = C.written(_fingerprints(theirs, "item_key"), f"{folder}/item-prints")
    left = a.select("key", "item_key", "total", "low", "high", F.inline(_blocks(radius)))
    right = b.select("item_key", F.col("low").alias("low_"), F.col("high").alias("high_"), F.col("total").alias("other"), F.inline(_blocks(radius)))
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("low_"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high_")))
    near = left.join(right, ["item_key", "block", "bits"]).where(apart <= radius).select("key", "item_key", (F.col("total") + F.col("other")).alias("sum")).distinct()
    shared = near.join(ours, "key").join(theirs.withColumnRenamed("weight", "w"), ["item_key", "gram"])
    sums = shared.groupBy("key", "item_key").agg(F.sum(F.least("weight", "w")).alias("both"), F.first("sum").alias("sum"))
    true = sums.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("key", "item_key", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))
    best = owners.select("doc_id", "item_key", "key").join(true, ["key", "item_key"]).groupBy("doc_id", "item_key").agg(F.max("similarity").alias("similarity"))
    return best.join(listed.select("item_id", "item_key"), "item_key").groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))
