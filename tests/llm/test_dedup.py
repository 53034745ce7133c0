"""Windows, byte strings and similarity links against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from gnomon.llm import common as C
from gnomon.llm import jaccard_join as J
from gnomon.llm import suffix_dedup as S
from gnomon.llm.components import components
from gnomon.llm.substring_dedup import remove_repeated_windows

LEAST = -(1 << 63)


def listed(docs):
    return [(LEAST if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]


def windows(rows, n):
    first = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def strings(rows, n):
    first = {}
    for i, t in rows:
        for j in range(len(t) - n + 1):
            k = t[j : j + n]
            first[k] = min((i, j), first.get(k, (i, j)))
    out = []
    for i, t in rows:
        gone = bytearray(len(t) + 1)
        for j in range(len(t) - n + 1):
            if first[t[j : j + n]] < (i, j):
                gone[j : j + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(gone[j] and not (j and gone[j - 1]) for j in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets.setdefault(i, []).append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in sets}


def noisy(spark, seed=3, count=60):
    """Groups of near copies at all distances, shared passages, short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6)))
    passage = [word() for _ in range(25)]
    rows = []
    for g in range(count // 6):
        base = [word() for _ in range(rnd.choice([3, 8, 30, 120]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 20))):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                w[len(w) // 2 : len(w) // 2] = passage
            rows.append((len(rows), " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(df, *cols):
    return sorted((LEAST if r[0] is None else r[0], *r[1:]) for r in df.select(*cols).collect())


def test_windows(spark, odd_docs, no_docs):
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert remove_repeated_windows(no_docs).count() == 0
    for docs in (odd_docs, noisy(spark)):
        for size in (2000, 8 << 20):
            assert got(remove_repeated_windows(docs, block_bytes=size), *cols) == windows(listed(docs), 13)


def test_intervals_of_the_transform():
    rnd = random.Random(5)
    for _ in range(100):
        n = rnd.choice([2, 5, 12, 30])
        contexts = list({bytes(rnd.choice(b"ab\0c"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 70))) for _ in range(rnd.randint(1, 6))})
        which, start, cls = S.repeated(contexts, n)
        have, want = {}, {}
        for a, b, c in zip(which.tolist(), start.tolist(), cls.tolist()):
            have.setdefault(c, set()).add((a, b))
        for i, c in enumerate(contexts):
            for j in range(len(c) - n + 1):
                want.setdefault(c[j : j + n], set()).add((i, j))
        assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_strings(spark, odd_docs, no_docs):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert S.remove_repeated_bytes(no_docs).count() == 0
    small = odd_docs.where("length(text) < 2000 or text is null")
    for docs in (small, noisy(spark)):
        for size, hot in ((2000, 2000), (8 << 20, 1)):
            assert got(S.remove_repeated_bytes(docs, block_bytes=size, hot=hot), *cols) == strings(listed(docs), 100)


@pytest.mark.parametrize("percent", [80, 60])
def test_links(spark, odd_docs, no_docs, percent):
    assert J.jaccard_groups(no_docs).count() == 0
    for docs in (odd_docs, noisy(spark)):
        want = groups(listed(docs), 5, percent)
        for kw in ({"block_bytes": 4000}, {"group": 100}):
            rows = J.jaccard_groups(docs, percent=percent, **kw).select("doc_id", "component_id").collect()
            assert {(LEAST if a is None else a): (LEAST if b is None else b) for a, b in rows} == want


def test_signatures_meet():
    """Every pair of similar sets shares a signature, small sets included."""
    rng, levels = np.random.default_rng(1), J.Levels(80)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 100, 300] * 6:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - len(a) // 10]], rng.integers(0, 1 << 63, len(a) // 10, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if levels.linked(len(a), len(b), both):
            sig, doc, level = J.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), levels)
            assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 40), (40, 50), (60, 50)], "u long, v long")
    assert dict((r["id"], r["component"]) for r in components(links).collect()) == {i: 1 for i in range(1, 21)} | {i: 30 for i in (30, 40, 50, 60)}


def test_copies_under_an_id_with_other_texts_are_linked(spark):
    from gnomon.llm.jaccard_join import jaccard_groups

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b + " tail"), (11, "something else")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_groups(docs).collect()) == [(1, 1), (5, 1), (5, 1), (9, 1), (11, 11)]


def test_long_words_that_swap_far_bytes(spark):
    a, b = "q" + "x" * 4095 + "z", "z" + "x" * 4095 + "q"
    tail = " ".join(f"t{i}" for i in range(6))
    docs = spark.createDataFrame([(1, f"{tail} {a} {tail}"), (2, f"{tail} {b} {tail}"), (3, f"{a} only"), (4, f"{b} only")], "doc_id long, text string")
    assert [r["n_removed"] for r in remove_repeated_windows(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    assert all(r["doc_id"] == r["component_id"] for r in J.jaccard_groups(docs).collect())


def test_long_texts(spark, odd_docs):
    """The very long rows alone, against a set of their strings."""
    rows = sorted((i, t) for i, t in listed(odd_docs.where("length(text) > 2000")))
    got_rows = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in S.remove_repeated_bytes(odd_docs.where("length(text) > 2000")).collect())
    first, want = {}, []
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - 99):
            if first.setdefault(hash(t[j : j + 100]), (i, j)) < (i, j):
                gone[j : j + 100] = b"\1" * 100
        want.append((i, len(t), sum(gone)))
    assert got_rows == want


def test_small_sets_do_not_meet_by_chance():
    """Sets of few features share signatures only if they share features, and each has a bounded number of them."""
    rng, levels = np.random.default_rng(9), J.Levels(80)
    for size in range(1, 11):
        sets = rng.integers(0, 1 << 63, (3000, size), dtype=np.uint64)
        sig, doc, _ = J.signatures(np.sort(sets, axis=1).ravel(), np.full(3000, size), levels)
        many = np.unique(sig, return_counts=True)[1]
        assert many.max() <= 4 and np.bincount(doc).max() <= 100, size


def test_a_passage_in_equal_surroundings_is_not_hot():
    """An anchor is hot by the contexts that its blocks would send, not by how often it stands there."""
    rnd = np.random.default_rng(5)
    text = lambda n: bytes(rnd.integers(97, 123, n, dtype=np.uint8))
    line = text(600)
    none = pa.table({"block": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "num": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
    sent = [S._send(100, 32, 0)(pa.table({"block": pa.array([b] * 20, pa.int32()), "doc_id": list(range(20 * b, 20 * b + 20)), "text": [text(150) + line + text(150) for _ in range(20)]}), none) for b in range(2)]
    for told, x in zip(S._answer(10)(pa.concat_tables(sent)).to_pylist(), sent, strict=True):
        n = len(C.unpack(x.column("anchors")[0].as_py()))
        again, hot = C.unbits(told["data"], 2 * n).reshape(2, n)
        assert (again & ~hot).sum() >= 5 and not (hot & ~again).any()


def test_removal_needs_no_anchors(monkeypatch):
    """The places of contexts come back to their block, so that its anchors are not computed a third time."""
    rnd = random.Random(3)
    text = lambda n: bytes(rnd.choice(b"abcdefgh \0") for _ in range(n))
    line, other = text(300), text(150)
    docs = [(1, text(50) + line), (2, line + text(80) + other), (2, other + line), (3, b""), (None, other + text(20) + other), (4, line * 2), (5, text(99))]
    table = pa.table({"block": pa.array([0] * len(docs), pa.int32()), "doc_id": [i for i, _ in docs], "text": pa.array([t for _, t in docs], pa.binary())})
    note = C.rows(S._NOTE, [])
    for hot in (1, 2000):
        sent = S._send(100, 32, 1)(table, note)
        told = [S._answer(hot)(sent.filter(pa.compute.equal(sent["shard"], s))) for s in set(sent["shard"].to_pylist())]
        contexts = S._contexts(100, 32, 1, 3)(table, pa.concat_tables(told))
        gone = [S._bucket(100)(contexts.filter(pa.compute.equal(contexts["bucket"], b))) for b in set(contexts["bucket"].to_pylist())]
        with monkeypatch.context() as m:
            m.setattr(S, "anchors", None)
            out = S._remove(100)(table, pa.concat_tables(gone))
        have = sorted((C.NULL_ID if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.to_pylist())
        assert have == strings([(C.NULL_ID if i is None else i, t) for i, t in docs], 100)
