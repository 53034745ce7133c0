"""What the operators of this folder share: shared folders, blocks of documents, word hashes and packed integers.

Documents are dealt into blocks of bounded size by a hash of their id. Work that needs knowledge of other blocks
travels as packed arrays: a block sends one row to each shard of the hash space, and a shard answers with one bit
for each number that it was sent, in the order in which it was sent. Blocks are rebuilt in the same order after an
executor is lost, because rows are sorted by id and text first.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions.storage import shared_dir  # noqa: F401

#: Bytes of text in a block, on average.
BLOCK_BYTES = 6 << 20
#: What stands for a null id where ids are compared: it sorts before all others.
NULL_ID = -(1 << 63)
#: Parts of a group that may be large.
SALTS = 32

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, without this call
    _libc = None

_rng = np.random.default_rng(20_240_611)
#: Two independent random words for each byte, and odd multipliers for each place in a word.
_BYTE = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers for each place in a window of words.
TERM = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a Parquet table in a shared folder: lineage ends here, and a lost executor loses nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def block_of(ident: Column, blocks: int, digest: Column | None = None) -> Column:
    """A block by id, or by id and digest of the text, so that rows of one id, or of none, do not all meet in one."""
    return F.pmod(F.xxhash64(ident, *([] if digest is None else [digest]), F.lit(17)), F.lit(blocks)).cast("int")


def in_blocks(docs: DataFrame, blocks: int, ident: str = "doc_id", text: str = "text", by_text: bool = False) -> DataFrame:
    """block, doc_id, text as bytes; a null text becomes empty."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(block_of(F.col(ident).cast("long"), blocks, F.md5(raw) if by_text else None).alias("block"), F.col(ident).cast("long").alias("doc_id"), raw.alias("text"))


def copies(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, first: rows whose whole text stands under a smaller doc_id, with the smallest such id.

    The groups are counted before anything is joined, and only groups of several rows are joined, on narrow rows and by
    digest and salt, so that one large group does not meet in one task.
    """
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("digest"))
    return copies_of(rows)


def copies_of(rows: DataFrame) -> DataFrame:
    """As copies(), of rows with doc_id and digest."""
    groups = rows.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.select("doc_id", "digest").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["digest", "salt"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "digest", "first")


def copy_notes(found: DataFrame, blocks: int, by_text: bool = False) -> DataFrame:
    """The copies as notes to the blocks that hold them: block, kind 0, num (the id), shard, data (the digest)."""
    return found.select(block_of(F.col("doc_id"), blocks, F.col("digest") if by_text else None).alias("block"), F.lit(0).alias("kind"), F.col("doc_id").alias("num"), F.lit(0).alias("shard"), F.col("digest").cast("binary").alias("data")).distinct()


def tidy() -> None:
    """Gives memory that is free in this process back to the system, which the allocators would otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def sorted_docs(left) -> tuple[np.ndarray, list[bytes], list]:
    """A block's rows in a fixed order: ids for comparison, texts, ids as they are."""
    raw = left.column("doc_id").to_pylist()
    texts = left.column("text").to_pylist()
    ids = [NULL_ID if x is None else x for x in raw]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return np.array([ids[i] for i in order], np.int64), [texts[i] for i in order], [raw[i] for i in order]


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x) + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(texts: list[bytes], families: int = 2) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of all words `[^\\x20\\x09-\\x0D]+`: first word of each text (one more at the end), lengths, hashes by family."""
    of_doc, _, lens, hashes = spans(texts, np.frombuffer(b" ".join(texts) + b" ", np.uint8), families)
    return of_doc, lens, hashes


def spans(texts: list[bytes], joined: np.ndarray, families: int = 2, lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """As words(), with where each word starts in the joined texts; lines: cut at spaces and line ends only."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=begins[1:])
    black = (joined != 32) & (joined != 10) if lines else (joined != 32) & ((joined < 9) | (joined > 13))
    edge = np.diff(black.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lens = ends - starts
    of_doc = np.searchsorted(starts, begins)
    if not len(starts):
        return of_doc, starts, lens, [np.empty(0, np.uint64) for _ in range(families)]
    b = joined[black]
    at = np.cumsum(lens) - lens
    place = np.arange(len(b)) - np.repeat(at, lens)
    far = np.flatnonzero(place >= len(_PLACE[0])) if lens.max() > len(_PLACE[0]) else at[:0]
    out = []
    for f in range(families):
        factor = _PLACE[f][place & (len(_PLACE[0]) - 1)]
        if len(far):  # places beyond the table have a factor of their own too
            factor[far] = mix(place[far].astype(np.uint64) * _PLACE[f][1]) | np.uint64(1)
        out.append(mix(np.add.reduceat(_BYTE[f][b] * factor, at) + lens.astype(np.uint64)))
    return of_doc, starts, lens, out


def windows(hashes: np.ndarray, of_doc: np.ndarray, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of n words inside one text: index of the first word, index of the text, hash."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    many = len(hashes) - n + 1
    h = np.zeros(many, np.uint64)
    for j in range(n):
        h += hashes[j : j + many] * TERM[family][j]
    doc = np.repeat(np.arange(len(of_doc) - 1), np.diff(of_doc))
    at = np.flatnonzero(doc[:many] == doc[n - 1 :])
    return at, doc[at], mix(h[at])


def pack(sorted_numbers: np.ndarray) -> bytes:
    """Sorted uint64 numbers as differences in byte planes, compressed."""
    if not len(sorted_numbers):
        return b""
    d = np.diff(sorted_numbers, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    used = max(1, int(np.flatnonzero(d.any(axis=0)).max(initial=0)) + 1)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d[:, :used].T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : packed[0]] = raw.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def unbits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), count=n).astype(bool)


def cell_bits(total: int, spare: int = 64) -> int:
    """Bits of a space with at least `spare` cells for each of `total` numbers."""
    return min(63, max(16, int(total * spare - 1).bit_length()))


def repeated_cells(parts: list[np.ndarray], local: list[np.ndarray]) -> list[np.ndarray]:
    """For each part's distinct sorted cells: whether the sum of all parts' counts is two or more.

    local: for each part, whether a cell already counts two or more there.
    """
    if not parts:
        return []
    every = np.concatenate(parts)
    twice = np.concatenate(local)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(s)))
    hot = (size > 1) | np.logical_or.reduceat(twice[order], at) if len(at) else np.empty(0, bool)
    flags = np.empty(len(s), bool)
    flags[order] = np.repeat(hot, size)
    return np.split(flags, np.cumsum([len(p) for p in parts])[:-1])


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are among some, which is sorted; a small table settles most of the others."""
    out = np.zeros(len(x), bool)
    if not len(some):
        return out
    low = np.uint64((1 << 22) - 1)
    there = np.zeros(1 << 22, bool)
    there[(some & low).view(np.int64)] = True
    maybe = np.flatnonzero(there[(x & low).view(np.int64)])
    y = x[maybe]
    out[maybe] = some[np.minimum(np.searchsorted(some, y), len(some) - 1)] == y
    return out


def order_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A stable order by a, then b."""
    order = np.argsort(a, kind="stable")
    s, t = a[order], b[order]
    if ((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any():
        order = np.lexsort((b, a))
    return order


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def rows(schema: str, values: list[tuple]) -> pa.Table:
    """An Arrow table of tuples, by a schema as Spark writes it."""
    names = [x.split() for x in schema.split(",")]
    cols = list(zip(*values, strict=True)) if values else [[] for _ in names]
    return pa.table({n: pa.array(c, _KINDS[k]) for (n, k), c in zip(names, cols, strict=True)})


def batch(schema: str, values: list[tuple]) -> pa.RecordBatch:
    t = rows(schema, values)
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.columns], names=t.column_names)


def shard_cuts(sorted_hashes: np.ndarray, bits_of_shard: int, width: int = 64) -> np.ndarray:
    """Where each of 2**bits_of_shard ranges of the hash space begins, and the end."""
    inner = np.arange(1, 1 << bits_of_shard, dtype=np.uint64) << np.uint64(width - bits_of_shard) if bits_of_shard else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, inner), [len(sorted_hashes)]]).astype(np.int64)
