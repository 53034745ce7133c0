"""Harmonic packing of documents into sequences.

Class k holds pieces of at most capacity / k ids and more than capacity / (k + 1); each of its sequences takes exactly k
of them. A document gives whole sequences first. What is left is cut: as long as k pieces of its length would leave
more than a 64th of a sequence empty, a piece of exactly capacity // (k + 1) ids, which fills class k + 1, is cut off.
Every task packs its own documents, so nothing is shuffled. At its end, pieces in sequences that did not fill are laid
one after another into full sequences, and the last rest goes to sequences whose lengths are powers of two, which need
no padding. All padding that is left is below a 64th of a sequence.

Defined cases: a null text is empty and gives the end id alone. Repeated rows and ids are packed as they come; a null
id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm import common as C
from gnomon.llm.tokens import encoder, with_end

CAPACITY = 4096
_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n ids, in order."""
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if n * 64 <= capacity or (capacity - k * n) * 64 <= capacity:
            out.append((n, k))
            break
        out.append((capacity // (k + 1), k + 1))
        n -= capacity // (k + 1)
    return out


class Packer:
    """One worker's open sequences. take() and rest() give pieces as (tag, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open, self.next = capacity, {}, 0

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        seq, offset, out = self.next, 0, []
        self.next += 1
        for tag, start, length in pieces:
            out.append((tag, start, length, seq, offset))
            offset += length
        return out

    def take(self, tag, n: int) -> list[tuple]:
        out, start = [], 0
        for length, k in cuts(n, self.capacity):
            held = self.open.setdefault(k, [])
            held.append((tag, start, length))
            start += length
            if len(held) == k:
                out += self._sequence(self.open.pop(k))
        return out

    def rest(self) -> list[tuple]:
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left, out, now = sum(p[2] for p in pieces), [], []
        room = self._room(left)
        for tag, start, length in pieces:
            while length:
                part = min(room, length)
                now.append((tag, start, part))
                start, length, room, left = start + part, length - part, room - part, left - part
                if not room:
                    out += self._sequence(now)
                    now, room = [], self._room(left)
        return out

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: one row for each piece."""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        tags = [p[0] for p in found]
        base = TaskContext.get().partitionId() << 32
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([t[0] for t in tags], pa.int64()),
            "start": pa.array([p[1] for p in found], pa.int64()),
            "length": pa.array([p[2] for p in found], pa.int64()),
            "ids": pa.array([t[1][p[1] : p[1] + p[2]].tobytes() for t, p in zip(tags, found, strict=True)], pa.binary()),
            "doc_tokens": pa.array([len(t[1]) for t in tags], pa.int64()),
            "sequence_id": pa.array([base + p[3] for p in found], pa.int64()),
            "offset": pa.array([p[4] for p in found], pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(capacity)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in C.chunks(texts):
                ids, many = with_end(*enc.encode(texts[a:b]), end)
                found = []
                for name, x in zip(names[a:b], np.split(ids.astype("<u4"), np.cumsum(many)[:-1]), strict=True):
                    # A copy, so that a piece that waits does not hold the whole batch.
                    found += packer.take((name, x.copy()), len(x))
                if found:
                    yield rows(found)
        if found := packer.rest():
            yield rows(found)

    cols = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    return cols.mapInArrow(run, _OUT)
