"""Groups of documents linked by n-gram Jaccard similarity, found with PartEnum signatures.

A document is the set of its distinct shingles. Sets are dealt into bands of sizes [l, l / similarity], so that similar
sets lie in one band or in two neighbouring ones; level j joins the bands j - 1 and j, whose similar sets differ in at
most k features. The feature domain is cut into n1 partitions of three parts. With at most k differences and
n1 > k / 2, some partition has at most one, so two of its three parts agree: a signature is the level, the partition,
and the features in two of its parts. n1 is chosen somewhat larger than needed, so that sets with an agreeing partition
without empty parts are found by signatures that are never empty. Sets with too many empty parts are told by counting;
they are joined among themselves by other cuts of the domain, and after the last cut by their empty signatures too,
so no link is lost. Where similar sets differ in at most one feature, each feature is a partition of its own: a set's
signatures are itself and itself without each feature, and none is ever empty.

Signatures that only one set has are dropped first: blocks tell shards which they hold, and learn which stand more than
once. Sets that share a signature are then compared by parity sketches: each feature flips one of b bits, so
the number of differing bits is never above the number of differing features. Pairs that it rules out can't be linked.
Each shard sends a spanning forest of the pairs that are left. Within the components that these make, sets are compared
exactly, set against those not yet reached, and each task sends a spanning forest of true links. A component beyond
GROUP features is cut into chunks, and every pair of chunks is a task of its own. So a group of thousands of near copies
makes rows in proportion to its size, and no link between components is lost.

Whole copies of a text are settled before.

Defined cases: documents without words or text have an empty set and are linked with nothing. Rows with the same id
count as one document, linked with all that any of them links to; a null id counts as an id that is smaller than all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm import common as C
from gnomon.llm.components import components

N, PERCENT = 5, 80
SPARE, CUTS = 1.25, 12
#: Cells of the space in which signatures are counted, for each expected signature; repeated ones are few, and meet in as much fewer shards.
CELLS, FEWER = 512, 4
#: Signatures in a shard on average; features in a task of exact comparison at most; sets of a signature compared at once.
SHARD, GROUP, FEW = 2 << 20, 8 << 20, 16
COPY, SEEN, MEMBER = 0, 1, 2
_SIZE = "doc_id long, digest string, n_shingles long"
_SENT = "block int, shard int, cells binary, twice binary"
_NOTE = "block int, kind int, num long, shard int, data binary"
_FOUND = "shard int, block int, signatures binary, docs binary, levels binary, ids binary, sizes binary, sketches binary, widths binary"
_LINK = "u long, v long"
_SET = "doc_id long, task long, side int, features binary"


def shingles(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text and sorted, and how many each has. A-Z count as a-z."""
    of_doc, _, (h,) = C.words([x.lower() for x in texts], 1)
    _, doc, g = C.windows(h, of_doc, n)
    many = np.diff(of_doc)
    short = np.flatnonzero((many > 0) & (many < n))
    if len(short):
        one = [np.uint64(0)] * len(short)
        for i, d in enumerate(short):
            a, b = of_doc[d], of_doc[d + 1]
            one[i] = C.mix((h[a:b] * C.TERM[1][: b - a]).sum(keepdims=True) + np.uint64(b - a))[0]
        doc, g = np.concatenate([doc, short]), np.concatenate([g, np.array(one, np.uint64)])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return g[new], np.bincount(doc[new], minlength=len(texts))


class Levels:
    """Bands of sizes, and each level's bound on differences, partitions and sketch width."""

    def __init__(self, percent: int):
        self.percent, self.top = percent, []
        low = 1
        while low < 1 << 40:
            self.top.append(max(low, low * 100 // percent))
            low = self.top[-1] + 1
        top = np.array(self.top, np.int64)
        self.top = top
        self.k = 2 * top * (100 - percent) // (100 + percent)
        self.n1 = np.where(self.k == 0, 1, np.ceil(SPARE * (self.k + 1) / 2)).astype(np.int64)
        self.width = np.clip(2 ** np.ceil(np.log2(2 * top)).astype(np.int64), 64, 4096)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, sizes)

    def linked(self, a, b, both):
        """Whether sets of a and b features with `both` in common are similar."""
        return 100 * both >= self.percent * (a + b - both)

    def possible(self, a, b, differ):
        """Whether sets of a and b features may be similar if they differ in at least so many."""
        return ((100 + self.percent) * differ <= (100 - self.percent) * (a + b)) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))


def signatures(features: np.ndarray, sizes: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all sets: signature, index of the set, level."""
    out = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    begin = np.cumsum(sizes) - sizes
    for step in (0, 1):
        left = np.flatnonzero(sizes)
        near = levels.k[levels.band(sizes[left]) + step] == 1
        out.append(_without_one(features, sizes, begin, left[near], levels.band(sizes[left[near]]) + step))
        left = left[~near]
        for cut in range(CUTS):
            if not len(left):
                break
            n = sizes[left]
            f = features[np.arange(int(n.sum())) + np.repeat(begin[left] - (np.cumsum(n) - n), n)]
            level = levels.band(n) + step
            k, n1 = levels.k[level], levels.n1[level]
            parts = np.where(k == 0, 1, 3)
            slots = n1 * parts
            base = np.cumsum(slots) - slots
            salt = C.mix((level * CUTS + cut + 1).astype(np.uint64))
            mixed = C.mix(f ^ np.repeat(salt, n))
            at = np.repeat(base, n) + (mixed % np.repeat(slots, n).astype(np.uint64)).astype(np.int64)
            total = int(slots.sum())
            sums, count = np.zeros(total, np.uint64), np.bincount(at, minlength=total)
            np.add.at(sums, at, C.mix(mixed + np.uint64(cut + 1)))
            # Three in a row make a partition; a level without differences has one part, the whole set.
            whole = np.flatnonzero(k == 0)
            out.append((C.mix(sums[base[whole]] + salt[whole]), left[whole], level[whole]))
            some = np.flatnonzero(k > 0)
            own = np.repeat(some, n1[some])
            first = np.arange(len(own)) - np.repeat(np.cumsum(n1[some]) - n1[some], n1[some])
            place = base[own] + 3 * first
            h, c = sums[place[:, None] + np.arange(3)], count[place[:, None] + np.arange(3)]
            name = C.mix(salt[own] + first.astype(np.uint64))
            bare = np.stack([(c[:, (q + 1) % 3] == 0) & (c[:, (q + 2) % 3] == 0) for q in range(3)], axis=1)
            risky = np.bincount(own, bare.any(axis=1), minlength=len(left)) >= n1 - k // 2
            risky[whole] = False
            for q in range(3):
                sig = C.mix(C.mix(h[:, (q + 1) % 3] + name) + h[:, (q + 2) % 3] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(q))
                keep = ~bare[:, q] if cut < CUTS - 1 else ~bare[:, q] | risky[own]
                out.append((sig[keep], left[own[keep]], level[own[keep]]))
            left = left[risky]
    sig, doc, level = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(sig, kind="stable")
    return sig[order], doc[order], level[order]


def _without_one(features: np.ndarray, sizes: np.ndarray, begin: np.ndarray, some: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets of which two are similar only if they differ in one feature at most."""
    n = sizes[some]
    if not len(some):
        return np.empty(0, np.uint64), some, level
    at = np.cumsum(n) - n
    salt = C.mix((level * CUTS).astype(np.uint64))
    x = C.mix(features[np.arange(int(n.sum())) + np.repeat(begin[some] - at, n)] ^ np.repeat(salt, n))
    whole = np.add.reduceat(x, at)
    sig = np.concatenate([C.mix(whole + salt), C.mix(np.repeat(whole + salt, n) - x)])
    return sig, np.concatenate([some, np.repeat(some, n)]), np.concatenate([level, np.repeat(level, n)])


def sketch(features: np.ndarray, width: int) -> np.ndarray:
    """Bits that the features flip, packed; halves that are added (xor) give the sketch of half the width."""
    at = (C.mix(features + np.uint64(77)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1)


class _Block:
    def __init__(self, docs: pa.Table, notes: pa.Table, n: int, levels: Levels):
        self.block, self.levels = docs.column("block")[0].as_py(), levels
        C.tidy()
        self.ids, self.texts, _ = C.sorted_docs(docs)
        rows = notes.to_pylist()
        self.notes = {x["shard"]: x["data"] for x in rows if x["kind"] == SEEN}
        listed = {(x["num"], bytes(x["data"])) for x in rows if x["kind"] == COPY}
        named = {x for x, _ in listed}
        own = [i for i, (d, t) in enumerate(zip(self.ids.tolist(), self.texts, strict=True)) if not (d in named and (d, hashlib.md5(t).hexdigest().encode()) in listed)]
        self.ids = self.ids[own]
        self.features, self.sizes, self.signatures, self.docs, self.level = [], [], [], [], []
        texts = [self.texts[i] for i in own]
        for a, b in C.chunks(texts):
            f, s = shingles(texts[a:b], n)
            sig, doc, level = signatures(f, s, levels)
            for have, x in ((self.features, f), (self.sizes, s), (self.signatures, sig), (self.docs, doc + a), (self.level, level)):
                have.append(x)
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.features, self.sizes = cat(self.features, np.uint64), cat(self.sizes, np.int64)
        sig, doc, level = cat(self.signatures, np.uint64), cat(self.docs, np.int64), cat(self.level, np.int64)
        order = np.argsort(sig, kind="stable")
        self.signatures, self.docs, self.level = sig[order], doc[order], level[order]

    def cells(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every = self.signatures >> np.uint64(64 - width)
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        at = np.flatnonzero(new)
        return every[at], np.diff(np.append(at, len(every))), every


def _send(n: int, levels: Levels, width: int, shards: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return C.rows(_SENT, [])
        b = _Block(docs, notes, n, levels)
        cells, count, _ = b.cells(width)
        cut = C.shard_cuts(cells, shards, width)
        return C.rows(_SENT, [(b.block, s, C.pack(cells[x:y]), C.bits(count[x:y] > 1)) for s, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x])

    return run


def _seen(group: pa.Table) -> pa.Table:
    rows = group.sort_by("block").to_pylist()
    parts = [C.unpack(x["cells"]) for x in rows]
    flags = C.repeated_cells(parts, [C.unbits(x["twice"], len(p)) for x, p in zip(rows, parts, strict=True)])
    return C.rows(_NOTE, [(x["block"], SEEN, 0, x["shard"], C.bits(f)) for x, f in zip(rows, flags, strict=True)])


def _found(n: int, levels: Levels, width: int, shards: int, fewer: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            b = _Block(docs, notes, n, levels)
            cells, count, _ = b.cells(width)
            cut = C.shard_cuts(cells, shards, width)
            flags = np.concatenate([np.empty(0, bool), *(C.unbits(b.notes[s], y - x) for s, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x)])
            hit = np.flatnonzero(np.repeat(flags, count))
            sig, doc, level = b.signatures[hit], b.docs[hit], b.level[hit]
            begin = np.cumsum(b.sizes) - b.sizes
            wide = levels.width[levels.band(b.sizes) + 1]
            made = {int(d): sketch(b.features[begin[d] : begin[d] + b.sizes[d]], int(wide[d])).tobytes() for d in np.unique(doc)}
            cut = C.shard_cuts(sig, fewer)
            for shard, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if y > x:
                    there, index = np.unique(doc[x:y], return_inverse=True)
                    rows.append((shard, b.block, C.pack(sig[x:y]), index.astype("<u4").tobytes(), level[x:y].astype(np.uint8).tobytes(), b.ids[there].tobytes(), b.sizes[there].astype("<i8").tobytes(), b"".join(made[int(d)] for d in there), wide[there].astype("<i4").tobytes()))
        return C.rows(_FOUND, rows)

    return run


class Forest:
    """Union-find over places, the smallest place on top."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _candidates(levels: Levels):
    def run(group: pa.Table) -> pa.Table:
        """A spanning forest of the pairs that share a signature and that sketches do not rule out."""
        C.tidy()
        rows = group.sort_by("block").to_pylist()
        ids = np.concatenate([np.frombuffer(x["ids"], np.int64) for x in rows])
        sizes = np.concatenate([np.frombuffer(x["sizes"], "<i8") for x in rows])
        widths = np.concatenate([np.frombuffer(x["widths"], "<i4") for x in rows]).astype(np.int64)
        base = np.cumsum([0, *(len(x["ids"]) // 8 for x in rows)])
        sig = np.concatenate([C.unpack(x["signatures"]) for x in rows])
        doc = np.concatenate([np.frombuffer(x["docs"], "<u4").astype(np.int64) + base[i] for i, x in enumerate(rows)])
        level = np.concatenate([np.frombuffer(x["levels"], np.uint8) for x in rows])
        bits, at = np.frombuffer(b"".join(x["sketches"] for x in rows), np.uint8), np.concatenate([[0], np.cumsum(widths // 8)])
        folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(levels.width[level]).tolist():
            mine = np.flatnonzero((widths == width) | (widths == 2 * width) | (widths == 4 * width))
            out = np.zeros((len(mine), width // 8), np.uint8)
            for wide in (width, 2 * width, 4 * width):
                some = np.flatnonzero(widths[mine] == wide)
                if len(some):
                    x = bits[at[mine[some]][:, None] + np.arange(wide // 8)]
                    while x.shape[1] > width // 8:
                        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                    out[some] = x
            where = np.full(len(ids), -1)
            where[mine] = np.arange(len(mine))
            folded[width] = (where, out.view(np.uint64) if width >= 64 else out)

        def passing(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
            where, x = folded[width]
            ok = np.zeros(len(a), bool)
            for s in range(0, len(a), 1 << 16):
                p, q = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                differ = np.bitwise_count(x[where[p]] ^ x[where[q]]).sum(axis=1, dtype=np.int64)
                ok[s : s + (1 << 16)] = levels.possible(sizes[p], sizes[q], differ)
            return ok

        order = np.lexsort((doc, sig))
        sig, doc, level = sig[order], doc[order], level[order]
        first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
        many = np.diff(np.append(first, len(sig)))
        forest = Forest(len(ids))
        pairs: dict[int, list[np.ndarray]] = {}
        for m in range(2, FEW + 1):
            g = first[many == m]
            for x in range(m):
                for y in range(x + 1, m):
                    for width in np.unique(levels.width[level[g]]).tolist():
                        h = g[levels.width[level[g]] == width]
                        pairs.setdefault(width, []).append(np.unique(doc[h + x] * len(ids) + doc[h + y]))
        for width, found in pairs.items():
            code = np.unique(np.concatenate(found))
            a, b = code // len(ids), code % len(ids)
            ok = passing(a, b, width) & (a != b)
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                forest.join(x, y)
        for s, m in zip(first[many > FEW].tolist(), many[many > FEW].tolist(), strict=True):
            width, rest = int(levels.width[level[s]]), np.unique(doc[s : s + m])
            while len(rest):  # each set reached is compared with those not yet reached
                queue, rest = [int(rest[0])], rest[1:]
                while queue and len(rest):
                    x = queue.pop()
                    ok = passing(np.full(len(rest), x), rest, width)
                    for y in rest[ok].tolist():
                        forest.join(x, y)
                        queue.append(y)
                    rest = rest[~ok]
        tops = [forest.top(i) for i in range(len(ids))]
        # One id may stand in several rows; those are one document.
        return C.rows(_LINK, sorted({(int(ids[i]), int(ids[t])) for i, t in enumerate(tops) if i != t and ids[i] != ids[t]}))

    return run


def linked(ids: np.ndarray, features: list[np.ndarray], levels: Levels) -> list[tuple[int, int]]:
    """A spanning forest of the links of these sets."""
    sizes = np.array([len(f) for f in features], np.int64)
    left, out = np.arange(len(ids)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = left[levels.possible(sizes[left], sizes[x], 0)]
            if not len(near):
                continue
            every = np.concatenate([features[i] for i in near])
            hit = features[x][np.minimum(np.searchsorted(features[x], every), sizes[x] - 1)] == every
            both = np.add.reduceat(hit, np.cumsum(sizes[near]) - sizes[near])
            got = near[levels.linked(sizes[near], sizes[x], both)]
            out += [(int(ids[x]), int(ids[y])) for y in got if ids[x] != ids[y]]
            queue += got.tolist()
            left = left[~np.isin(left, got)]
    return out


def _members(n: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows and notes.num_rows:
            ids, texts, _ = C.sorted_docs(docs)
            told: dict[int, list[tuple[int, int]]] = {}
            for x in notes.to_pylist():
                told.setdefault(x["doc_id"], []).append((x["task"], x["side"]))
            own = [i for i, d in enumerate(ids.tolist()) if d in told]
            texts, ids = [texts[i] for i in own], ids[own].tolist()
            seen = set()
            for a, b in C.chunks(texts):
                f, s = shingles(texts[a:b], n)
                for d, x in zip(ids[a:b], np.split(f, np.cumsum(s)[:-1]), strict=True):
                    raw = x.tobytes()
                    if len(x) and (d, raw) not in seen:
                        seen.add((d, raw))
                        rows += [(d, task, side, raw) for task, side in told[d]]
        return C.rows(_SET, rows)

    return run


def _exact(levels: Levels):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("side").to_pylist(), group.column("doc_id").to_pylist(), group.column("features").to_pylist(), strict=True))
        out: list[tuple[int, int]] = []
        of: dict[int, list[int]] = {}
        for i, x in enumerate(rows):
            of.setdefault(x[0], []).append(i)
        for some in of.values():
            out += linked(np.array([rows[i][1] for i in some], np.int64), [np.frombuffer(rows[i][2], np.uint64) for i in some], levels)
        return C.rows(_LINK, sorted(set(out)))

    return run


def jaccard_groups(docs: DataFrame, n: int = N, percent: int = PERCENT, group: int = GROUP, ident: str = "doc_id", text: str = "text", block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when 100 * intersection >= percent * union of their shingle sets."""
    spark, levels = docs.sparkSession, Levels(percent)
    folder = C.shared_dir(spark)
    blocks = C.block_count(docs, text, block_bytes)
    expected = blocks * block_bytes // 4
    width, shards = C.cell_bits(expected, CELLS), max(0, (expected // SHARD).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column(2).to_pylist(), []
            for a, b in C.chunks(texts):
                sizes.append(shingles(texts[a:b], n)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], names=["doc_id", "digest", "n_shingles"])

    raw = docs.select(F.coalesce(F.col(ident).cast("long"), F.lit(C.NULL_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    sizes = C.written(raw.select("doc_id", F.md5("text").alias("digest"), "text").mapInArrow(count, _SIZE), f"{folder}/sizes")
    found = C.written(C.copies_of(sizes.where("n_shingles > 0")), f"{folder}/copies")
    note = C.copy_notes(found, blocks)
    rows = C.in_blocks(raw, blocks, "doc_id", "text")
    left = lambda: rows.groupBy("block")
    sent = left().cogroup(note.groupBy("block")).applyInArrow(_send(n, levels, width, shards), _SENT)
    known = note.unionByName(sent.groupBy("shard").applyInArrow(_seen, _NOTE))
    held = left().cogroup(known.groupBy("block")).applyInArrow(_found(n, levels, width, shards, max(0, shards - FEWER)), _FOUND)
    near = components(held.groupBy("shard").applyInArrow(_candidates(levels), _LINK))

    # Tasks of exact comparison: many small components in one, or two chunks of a large one.
    near = C.written(near.join(sizes.groupBy("doc_id").agg(F.sum("n_shingles").alias("n")), near["id"] == F.col("doc_id")).select("doc_id", "component", "n"), f"{folder}/near")
    large = near.groupBy("component").agg(F.sum("n").alias("total")).where(F.col("total") > group).select("component", F.ceil(F.col("total") * 2 / group).cast("int").alias("chunks"))
    tasks = max(1, blocks)
    small = near.join(large, "component", "left_anti").select("doc_id", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"), F.pmod(F.xxhash64("component"), F.lit((1 << 31) - 1)).cast("int").alias("side"))
    cut = near.join(large, "component").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    cut = cut.select("doc_id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    cut = cut.select("doc_id", (F.lit(tasks) + F.pmod(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")), F.lit(1 << 60))).alias("task"), F.lit(0).alias("side"))
    asked = small.unionByName(cut).withColumn("block", C.block_of(F.col("doc_id"), blocks))
    sets = left().cogroup(asked.groupBy("block")).applyInArrow(_members(n), _SET)
    linked_ = sets.groupBy("task").applyInArrow(_exact(levels), _LINK)
    # An id that stands with other texts too ties a copy's group to theirs.
    several = sizes.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    ties = found.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    exact = components(linked_.unionByName(ties))
    first = sizes.join(found.select("doc_id", "digest", "first"), ["doc_id", "digest"], "left").withColumn("node", F.coalesce("first", "doc_id"))
    spread = exact.select(F.col("id").alias("node"), "component", F.explode(F.sequence(F.lit(0), F.lit(C.SALTS - 1))).alias("salt"))
    out = first.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(C.SALTS)).cast("int")).join(spread, ["node", "salt"], "left")
    null = lambda c: F.when(c != C.NULL_ID, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), "n_shingles", null(F.coalesce("component", "node")).alias("component_id"))
