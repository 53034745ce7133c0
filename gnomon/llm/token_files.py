"""Token ids in files of patched frame-of-reference blocks.

A file holds the documents of one range of ids, in ascending order. Its ids are cut into blocks of BLOCK values. A block
subtracts its minimum and packs what is left at the width that holds the `quantile` smallest part of its values; the
others are exceptions: their places and values stand in a list behind the packed bits, and zeros in their places. An
index of the blocks' starts allows reading any range of ids without the blocks before it.

Layout, little-endian: magic "PFR1"; blocks; index: for each block u64 start; documents: i64 id, u8 null mark, u64 ids
before it in the file (one more at the end); then u64 blocks, u64 documents, u64 offset of the index, u32 block size.
A block: u32 minimum, u32 values, u32 exceptions, u8 width, packed bits, u16 places, u32 values less the minimum.

An attempt writes a file of its own name, and the manifest, which holds only attempts that were committed, tells which files
count; readers open those by name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gnomon.llm import common as C
from gnomon.llm.tokens import encoder, with_end

MAGIC, BLOCK, QUANTILE = b"PFR1", 4096, 0.9
#: Bytes of text in a file, on average.
FILE_BYTES = 16 << 20
_HEAD, _TAIL = struct.Struct("<IIIB"), struct.Struct("<QQQI")


def pack_block(values: np.ndarray, quantile: float = QUANTILE) -> bytes:
    low = int(values.min())
    d = (values - np.uint32(low)).astype("<u4")
    width = int(np.partition(d, k := max(0, int(np.ceil(quantile * len(d))) - 1))[k]).bit_length()
    out = np.flatnonzero(d >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    over = d[out]
    d[out] = 0
    packed = np.packbits(np.unpackbits(d.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width], bitorder="little")
    return _HEAD.pack(low, len(d), len(out), width) + packed.tobytes() + out.astype("<u2").tobytes() + over.tobytes()


def unpack_block(raw: bytes, at: int = 0) -> np.ndarray:
    low, n, many, width = _HEAD.unpack_from(raw, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    d = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    places = np.frombuffer(raw, "<u2", many, at + size)
    d[places] = np.frombuffer(raw, "<u4", many, at + size + 2 * many)
    return d + np.uint32(low)


class FileWriter:
    def __init__(self, sink, block: int = BLOCK, quantile: float = QUANTILE):
        self.sink, self.block, self.quantile = sink, block, quantile
        self.rest, self.starts, self.ids, self.null, self.before = np.empty(0, np.uint32), [], [], [], [0]
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def _put(self, values: np.ndarray) -> None:
        raw = pack_block(values, self.quantile)
        self.starts.append(self.at)
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, doc_ids: list, ids: np.ndarray, many: np.ndarray) -> None:
        self.ids += [0 if x is None else x for x in doc_ids]
        self.null += [x is None for x in doc_ids]
        self.before += (self.before[-1] + np.cumsum(many)).tolist()
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        for a in range(0, len(ids) - self.block + 1, self.block):
            self._put(ids[a : a + self.block])
        self.rest = ids[len(ids) // self.block * self.block :]

    def close(self) -> int:
        if len(self.rest):
            self._put(self.rest)
        self.sink.write(np.array(self.starts, "<u8").tobytes() + np.array(self.ids, "<i8").tobytes() + np.array(self.null, np.uint8).tobytes() + np.array(self.before, "<u8").tobytes())
        self.sink.write(_TAIL.pack(len(self.starts), len(self.ids), self.at, self.block))
        return self.before[-1]


class File:
    """A file's bytes, with the ids of any range."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token blocks")
        self.raw = raw
        blocks, docs, at, self.block = _TAIL.unpack_from(raw, len(raw) - _TAIL.size)
        self.starts = np.frombuffer(raw, "<u8", blocks, at)
        at += 8 * blocks
        self.ids = np.frombuffer(raw, "<i8", docs, at)
        self.null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
        self.before = np.frombuffer(raw, "<u8", docs + 1, at + 9 * docs).astype(np.int64)

    def range(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-end // self.block)
        got = np.concatenate([unpack_block(self.raw, int(x)) for x in self.starts[a:b]])
        return got[start - a * self.block : end - a * self.block]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, ident: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns file, part, docs, ids: one row for each file, as written.

    A null text counts as empty, a null id sorts first, rows with one id stand in the order of their texts' hashes.
    """
    parts = C.block_count(docs, text, file_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name = f"part-{part:08d}-{attempt}.pfr"
        enc = encoder(tokenizer)
        n = 0
        with store.open_output_stream(f"{top}/{name}") as sink:
            out = FileWriter(sink)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in C.chunks(texts):
                    out.add(ids[a:b], *with_end(*enc.encode(texts[a:b]), end))
                n += len(ids)
            total = out.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "docs": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64())})

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return C.written(dealt.mapInArrow(run, "file string, part int, docs long, ids long"), f"{folder.rstrip('/')}-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{name}") as source:
                    f = File(source.read())
                docs = len(f.ids)
                step = max(1, docs * (1 << 20) // max(1, int(f.before[-1])))
                for a in range(0, docs, step):
                    b = min(docs, a + step)
                    ids = f.range(int(f.before[a]), int(f.before[b])).astype("<u4")
                    cut = (f.before[a : b + 1] - f.before[a]) * 4
                    raw_ids = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cut.astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(f.ids[a:b], pa.int64(), mask=f.null[a:b]), "start": f.before[a:b] + before, "n_tokens": np.diff(f.before[a : b + 1]), "ids": raw_ids})

    # Ids before each file: before its stretch of the files, and before it in the stretch.
    files = manifest.withColumn("stretch", F.floor(F.col("part") / 1024))
    totals = files.groupBy("stretch").agg(F.sum("ids").alias("n")).select("stretch", F.coalesce(F.sum("n").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(W.partitionBy("stretch").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("inside", inside).join(totals, "stretch").select("file", (F.col("base") + F.col("inside")).alias("before"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
