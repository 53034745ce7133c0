"""Word windows with DataFrame functions only: no Python runs on the executors.

Words are what stands between white space of a text in lower case. A shingle is n words in a row, known by its
xxhash64. Texts are first searched for shingles of a fixed set of patterns: a bit field tells for every shingle of a
text, without a shuffle, whether it may be one of them; only positions that it admits become rows and are joined exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the bit field (a bit each), and shingles of patterns that one field and one broadcast may hold.
FIELD, BOUND = 1 << 19, 1 << 16


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once, however often later expressions name it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def shingle(hashes: Column, at: Column, n: int, size: Column | None = None) -> Column:
    """The hash of n words (or of size words, n at most) from the 1-based place on; xxhash64 passes over nulls."""
    word = lambda j: F.element_at(hashes, (at + F.lit(j)).cast("int"))
    return F.xxhash64(*[word(j) if size is None else F.when(F.lit(j) < size, word(j)) for j in range(n)])


def places(hashes: Column, n: int | Column) -> Column:
    """The 1-based places of all shingles of n words."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - n + 1)).otherwise(F.array().cast("array<int>"))


def pattern_shingles(patterns: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """ident, many (words), size (words of a shingle: n, or all words of a shorter pattern), place (1-based), sh."""
    words = held(patterns.select(F.col(ident).cast("long").alias(ident) if dict(patterns.dtypes)[ident] != "string" else F.col(ident), word_list(F.col(text)).alias("raw")), "h", F.transform("raw", lambda w: F.xxhash64(w)))
    words = words.where(F.size("h") > 0).withColumn("many", F.size("h")).withColumn("size", F.least(F.lit(n), "many"))
    rows = words.select(ident, "many", "size", "h", F.explode(places(F.col("h"), F.col("size"))).alias("place"))
    return rows.select(ident, "many", "size", "place", shingle(F.col("h"), F.col("place"), n, F.col("size")).alias("sh"))


def _admitted(field: np.ndarray, size: int) -> Column:
    """The places whose shingles the bit field admits. The field goes into the plan as an array of longs, which is folded there."""
    longs = F.from_json(F.lit("[" + ",".join(map(str, field.tolist())) + "]"), "array<bigint>")

    def known(i: Column) -> Column:
        place = F.pmod(shingle(F.col("h"), i, size), F.lit(FIELD))
        return F.getbit(F.element_at(longs, (F.shiftright(place, 6) + 1).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.filter(places(F.col("h"), size), known)


def found_places(docs: DataFrame, keep: list[str], text: str, shingles: DataFrame, bound: int = BOUND) -> DataFrame:
    """keep, words, at (1-based place in the text), and the pattern's columns: one row for each shingle of a pattern in a text.

    shingles (from pattern_shingles, written) are dealt into parts of at most `bound` rows by their hash, with ever finer
    parts until each is within it. Each part makes its own bit fields, one for each size of a shingle, and reads the texts
    once for all sizes: any number of patterns is found, at the price of one reading for each `bound` shingles.
    """
    known = shingles.select("sh", "size").distinct()
    parts = max(1, -(-2 * known.count() // bound)) if known.count() > bound else 1
    base = held(docs.select(*keep, word_list(F.col(text)).alias("raw")), "words", F.col("raw")).drop("raw")
    base = held(base, "h", F.transform("words", lambda w: F.xxhash64(w)))
    out = None
    for part in range(parts):
        mine = known if parts == 1 else known.where(F.pmod("sh", F.lit(parts)) == part)
        some = mine.limit(bound + 1).collect()
        if len(some) > bound:
            raise ValueError(f"more than {bound} shingles in one part of {parts}")
        here = shingles if parts == 1 else shingles.where(F.pmod("sh", F.lit(parts)) == part)
        rows = _found(base, keep, some).join(F.broadcast(here) if parts == 1 else here, ["sh", "size"])
        out = rows if out is None else out.unionByName(rows)
    return out


def _found(base: DataFrame, keep: list[str], known: list) -> DataFrame:
    sizes, spots = sorted({r["size"] for r in known}) or [1], []  # without patterns, one round that finds nothing
    for size in sizes:
        field = np.zeros(FIELD, np.uint8)
        field[[r["sh"] % FIELD for r in known if r["size"] == size]] = 1
        field = np.packbits(field, bitorder="little").view("<i8")
        kind = F.lit(size).alias("size")
        spots.append(F.transform(_admitted(field, size), lambda i: F.struct(i.alias("at"), kind)))  # noqa: B023
    return base.select(*keep, "words", "h", F.inline(F.concat(*spots))).withColumn("sh", shingle(F.col("h"), F.col("at"), max(sizes), F.col("size"))).drop("h")
