"""Removal of repeated word windows behind a count-min prefilter.

Pass 1: every block of documents makes a count-min sketch of its word windows, of two rows, kept as the sorted list of
its non-zero cells. The sketches are merged, shard by shard of the cell space, and every block learns which of its cells
count two or more. The estimate of a window is the smaller of its two cells, never below its true count, so no
repeated window is lost. The width follows the input (64 cells for each window at least), so the share of windows that
pass by chance stays the same at any size.

Pass 2: only windows estimated at two or more are grouped, by 128 bits of two independent hashes. A block sends each
distinct window once, with its smallest id, so a window in a third of all documents makes one row for each block.

Whole copies of a text are settled before: they need no windows.

Defined cases: a null or empty text has no words. A null id sorts before all others. Rows with the same id do not
remove each other's words, since neither id is smaller; repeated rows are thus kept alike. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm import common as C

N = 13
_SKETCH = "block int, num int, shard int, cells binary, twice binary"
_NOTE = "block int, kind int, num long, shard int, data binary"
_ENTRY = "block int, shard int, low binary, high binary, first binary"
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
COPY, CELLS, LATER = 0, 1, 2
#: Cells, or windows, in a shard on average.
SHARD = 2 << 20


class _Block:
    """A block's documents and the windows of those that are not copies."""

    def __init__(self, docs: pa.Table, notes: pa.Table, n: int):
        self.block = docs.column("block")[0].as_py()
        C.tidy()
        self.ids, self.texts, self.raw = C.sorted_docs(docs)
        notes = notes.to_pylist()
        self.notes = {(x["kind"], x["num"], x["shard"]): x["data"] for x in notes if x["kind"] != COPY}
        listed = {(x["num"], bytes(x["data"])) for x in notes if x["kind"] == COPY}
        named = {x for x, _ in listed}
        self.copy = np.array([int(i) in named and (int(i), hashlib.md5(t).hexdigest().encode()) in listed for i, t in zip(self.ids, self.texts, strict=True)], bool)
        self.own = np.flatnonzero(~self.copy)
        at, doc, low, high, first = [], [], [], [], 0
        self.first_word = [0]
        own = [self.texts[i] for i in self.own]
        for a, b in C.chunks(own):
            of_doc, _, hashes = C.words(own[a:b])
            w, d, h = C.windows(hashes[0], of_doc, n, 0)
            at.append(w + first)
            doc.append(d + a)
            low.append(h)
            high.append(C.windows(hashes[1], of_doc, n, 1)[2])
            self.first_word += [int(x) + first for x in of_doc[1:]]
            first = self.first_word[-1]
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.at, self.doc = cat(at, np.int64), cat(doc, np.int64)
        self.hashes = [cat(low, np.uint64), cat(high, np.uint64)]

    def cells(self, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct cells, and which of them count two or more here."""
        every = np.sort(self.hashes[row] >> np.uint64(64 - width))
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        at = np.flatnonzero(new)
        return every[at], np.diff(np.append(at, len(every))) > 1

    def estimated(self, width: int, shards: int) -> np.ndarray:
        """The windows whose estimate is two or more."""
        hit = np.arange(len(self.at))
        for row in (0, 1):
            cells, _ = self.cells(row, width)
            ends = np.searchsorted(cells, (np.arange(1, (1 << shards) + 1, dtype=np.uint64)) << np.uint64(width - shards))
            flags, a = np.zeros(len(cells), bool), 0
            for shard, b in enumerate(ends):
                if b > a:
                    flags[a:b] = C.unbits(self.notes[CELLS, row, shard], b - a)
                a = b
            hit = hit[C.among(self.hashes[row][hit] >> np.uint64(64 - width), cells[flags])]
        return hit

    def entries(self, width: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct windows estimated repeated: both hashes and the first document; the windows and their entry."""
        hit = self.estimated(width, shards)
        hit = hit[C.order_of_pairs(self.hashes[0][hit], self.hashes[1][hit])]
        low, high = self.hashes[0][hit], self.hashes[1][hit]
        new = np.ones(len(hit), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        at = np.flatnonzero(new)
        return low[at], high[at], self.ids[self.own[self.doc[hit[at]]]], hit, np.cumsum(new) - 1


def _sketch(width: int, shards: int, n: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            b = _Block(docs, notes, n)
            for row in (0, 1):
                cells, twice = b.cells(row, width)
                cut = np.searchsorted(cells, (np.arange(1, (1 << shards), dtype=np.uint64)) << np.uint64(width - shards))
                for shard, (c, t) in enumerate(zip(np.split(cells, cut), np.split(twice, cut), strict=True)):
                    if len(c):
                        rows.append((b.block, row, shard, C.pack(c), C.bits(t)))
        return C.rows(_SKETCH, rows)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """The sum of the blocks' sketches in one row and shard: a bit for each cell that a block sent."""
    group = group.sort_by("block").to_pylist()
    parts = [C.unpack(x["cells"]) for x in group]
    flags = C.repeated_cells(parts, [C.unbits(x["twice"], len(p)) for x, p in zip(group, parts, strict=True)])
    return C.rows(_NOTE, [(x["block"], CELLS, x["num"], x["shard"], C.bits(f)) for x, f in zip(group, flags, strict=True)])


def _exact(width: int, shards: int, n: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            b = _Block(docs, notes, n)
            low, high, first, _, _ = b.entries(width, shards)
            cut = np.searchsorted(low, np.arange(1, 1 << shards, dtype=np.uint64) << np.uint64(64 - shards)) if shards else []
            for shard, (x, y, z) in enumerate(zip(np.split(low, cut), np.split(high, cut), np.split(first, cut), strict=True)):
                if len(x):
                    rows.append((b.block, shard, C.pack(x), y.tobytes(), z.tobytes()))
        return C.rows(_ENTRY, rows)

    return run


def _group(group: pa.Table) -> pa.Table:
    """Groups equal windows of all blocks: a bit for each entry, set if it stands under a smaller id in another block."""
    group = group.sort_by("block").to_pylist()
    size = [len(x["first"]) // 8 for x in group]
    low = np.concatenate([C.unpack(x["low"]) for x in group])
    high = np.concatenate([np.frombuffer(x["high"], np.uint64) for x in group])
    first = np.concatenate([np.frombuffer(x["first"], np.int64) for x in group])
    order = C.order_of_pairs(low, high)
    l, h, f = low[order], high[order], first[order]
    new = np.ones(len(l), bool)
    new[1:] = (l[1:] != l[:-1]) | (h[1:] != h[:-1])
    least = np.minimum.reduceat(f, np.flatnonzero(new))[np.cumsum(new) - 1]
    later = np.empty(len(l), bool)
    later[order] = f > least
    return C.rows(_NOTE, [(x["block"], LATER, 0, x["shard"], C.bits(p)) for x, p in zip(group, np.split(later, np.cumsum(size)[:-1]), strict=True)])


def _remove(width: int, shards: int, n: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return C.rows(_OUT, [])
        b = _Block(docs, notes, n)
        low, _, first, hit, entry = b.entries(width, shards)
        cut = np.searchsorted(low, np.arange(1, (1 << shards) + 1, dtype=np.uint64) << np.uint64(64 - shards)) if shards else np.array([len(low)])
        if shards:
            cut[-1] = len(low)
        later, a = np.zeros(len(low), bool), 0
        for shard, c in enumerate(cut):
            if c > a:
                later[a:c] = C.unbits(b.notes[LATER, 0, shard], c - a)
            a = c
        gone = later[entry] | (b.ids[b.own[b.doc[hit]]] > first[entry])
        cover = np.zeros(b.first_word[-1] + 1, np.int64)
        np.add.at(cover, b.at[hit[gone]], 1)
        np.add.at(cover, b.at[hit[gone]] + n, -1)
        cover = np.cumsum(cover[:-1]) > 0
        rows, own = [], 0
        for i, text in enumerate(b.texts):
            kept = text.split()
            many = len(kept)
            if b.copy[i]:
                kept = kept if many < n else []
            else:
                c = cover[b.first_word[own] : b.first_word[own + 1]]
                own += 1
                if c.any():
                    kept = [w for w, x in zip(kept, c.tolist(), strict=True) if not x]
            kept_count, kept = len(kept), b" ".join(kept)
            rows.append((b.raw[i], many, many - kept_count, hashlib.sha256(kept).hexdigest(), kept))
        return C.rows(_OUT, rows)

    return run


def remove_repeated_windows(docs: DataFrame, n: int = N, ident: str = "doc_id", text: str = "text", block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (bytes): each word goes that lies in a window of n words which also starts in a document with a smaller id."""
    spark = docs.sparkSession
    blocks = C.block_count(docs, text, block_bytes)
    expected = blocks * block_bytes // 4  # windows, at most about one for each four bytes
    width = C.cell_bits(expected)
    shards = max(1, (expected // SHARD).bit_length())
    rows = C.in_blocks(docs, blocks, ident, text, by_text=True)
    # Narrow beside the text, and kept as a table: the three passes below do not work it out again.
    note = C.copy_notes(C.written(C.copies(docs, ident, text), f"{C.shared_dir(spark)}/copies"), blocks, by_text=True)
    left = lambda: rows.groupBy("block")
    sketch = left().cogroup(note.groupBy("block")).applyInArrow(_sketch(width, shards, n), _SKETCH)
    cells = sketch.groupBy("num", "shard").applyInArrow(_merge, _NOTE)
    known = note.unionByName(cells)
    entries = left().cogroup(known.groupBy("block")).applyInArrow(_exact(width, shards, n), _ENTRY)
    later = entries.groupBy("shard").applyInArrow(_group, _NOTE)
    return left().cogroup(known.unionByName(later).groupBy("block")).applyInArrow(_remove(width, shards, n), _OUT)
