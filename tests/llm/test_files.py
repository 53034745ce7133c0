"""Token files, packing, archives and top-k: round trips and brute force."""

import collections
import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gnomon.llm import common as C
from gnomon.llm import packing as P
from gnomon.llm import token_files as B
from gnomon.llm import topk as K
from gnomon.llm import warc as A
from gnomon.llm.tokens import encoder

ODD = ["", " ", "a  b", "a \n b", "x\n\ny \n z ", " lead", "trail ", "don't we'll I'M", "café İstanbul ß", "tab\tnew\r\nline", "a<|endoftext|>b", "你好 hi", "éx", "12 345 6a7", "a b  c", "x\x1cy", "\n", "a\n\n b", "foo — bar…"]


def test_cached_ids_are_the_library_s():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        texts = [a + b for a in ODD for b in ODD]
        ids, many = encoder(name).encode([t.encode() for t in texts])
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words_that_swap_far_bytes():
    """Words of one length whose bytes change places 4,096 or more apart are different words."""
    for middle in (4095, 8191, 5000):
        a, b = "q" + "x" * middle + "z", "z" + "x" * middle + "q"
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            ids, many = encoder(name).encode([f"a {a} b".encode(), f"a {b} b".encode()])
            plain = Tokenizer.from_file(public_tokenizers.path(name))
            assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [plain.encode(f"a {w} b", add_special_tokens=False).ids for w in (a, b)]
        _, _, hashes = C.words([a.encode(), b.encode()])
        assert all(h[0] != h[1] for h in hashes)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for values in ([0], [7] * 50, rng.integers(0, 50_000, 4096), rng.integers(0, 1 << 32, 100), [1] * 99 + [(1 << 32) - 1]):
        x = np.array(values, np.uint32)
        assert (B.unpack_block(B.pack_block(x)) == x).all()


def test_token_files(spark, odd_docs, no_docs):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd_docs, no_docs):
        folder = f"{C.shared_dir(spark)}/ids"
        manifest = B.write_token_files(docs, folder, "byte_bpe_50k.json", 2, file_bytes=50_000)
        rows = sorted(B.read_token_files(spark, folder, manifest).collect(), key=lambda r: r["start"])
        want = [plain.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()]
        assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows) == sorted(want)
        assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert ids == sorted(ids)


def test_packing(spark, odd_docs, no_docs):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert P.pack(no_docs, "word_bpe_49k.json", 2).count() == 0
    rows = P.pack(odd_docs, "word_bpe_49k.json", 2).collect()
    whole = sorted(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in odd_docs.collect())
    assert sum(r["length"] for r in rows) == sum(map(len, whole)) and all(len(r["ids"]) == 4 * r["length"] for r in rows)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for x in seqs.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert at <= 4096
    assert padding * 50 <= sum(map(len, whole))
    # The pieces of a document, put together by their starts, are its ids.
    docs = {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    put = []
    for (_, n), parts in docs.items():
        copies = sum(1 for start, _ in parts if start == 0)  # equal rows are cut alike
        parts = sorted(parts)
        assert sum(len(x) // 4 for _, x in parts) == n * copies
        if copies == 1:
            put.append(np.frombuffer(b"".join(x for _, x in parts), "<u4").tolist())
            assert [s for s, _ in parts] == np.cumsum([0, *(len(x) // 4 for _, x in parts)])[:-1].tolist()
    single = collections.Counter((r["doc_id"], len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd_docs.collect())
    assert sorted(put) == sorted(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in odd_docs.collect() if single[r["doc_id"], len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1] == 1)


def test_columns_that_clash(spark):
    """Tables whose other columns are named like those used inside."""
    pages = spark.createDataFrame([(1, "u", "h" * 2000, "d", 9), (2, "v", "h" * 2000, "d", 9)], "page_id long, url string, html string, digest string, salt int")
    folder = f"{C.shared_dir(spark)}/clash"
    assert {r["page_id"]: r["refers_to"] for r in A.read_warc(A.write_warc(pages, folder), folder).collect()} == {1: 2, 2: None}
    vectors = spark.createDataFrame([(0, [1.0], 1, 1, 1), (1, [2.0], 1, 1, 1), (None, [3.0], 1, 1, 1)], "vec_id long, embedding array<float>, id int, dim int, block int")
    assert [tuple(r) for r in K.top_k(vectors, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    docs = spark.createDataFrame([(1, "a b", 1, 1)], "doc_id long, text string, tie int, file int")
    folder = f"{C.shared_dir(spark)}/clash-ids"
    assert B.read_token_files(spark, folder, B.write_token_files(docs, folder, "byte_bpe_50k.json", 2)).count() == 1


def test_a_very_long_page(spark):
    html = "<p>" + "long " * 2_000_000
    folder = f"{C.shared_dir(spark)}/long"
    index = A.write_warc(spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id long, url string, html string"), folder)
    rows = {r["page_id"]: r for r in A.read_warc(index, folder).select("page_id", "payload_bytes", "refers_to").collect()}
    assert rows[1]["payload_bytes"] == len(html) and rows[1]["refers_to"] == 2


def test_scores_beyond_doubles(spark):
    big = [float(2**21 + 1), float(2**21 - 1), 1.0]
    rows = [(0, big), (1, big), (2, [-x for x in big])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [int(256 * x) for x in big]
    assert [(r["vec_id"], r["score"]) for r in K.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, sum(x * x for x in want)), (2, -sum(x * x for x in want))]
    with pytest.raises(Exception, match="too large"):  # beyond 64 bits
        K.top_k(df.select("vec_id", F.transform("embedding", lambda x: x * 1024).alias("embedding")), F.col("vec_id") == 0).collect()


def test_cuts_cover():
    for n in [*range(1, 9000, 7), 4096, 8192]:
        assert sum(x for x, _ in P.cuts(n)) == n and all(x * k <= 4096 for x, k in P.cuts(n))


def test_archives(spark):
    big = "<p>" + "y" * 1500
    pages = spark.createDataFrame([(1, "http://a/", big), (2, None, big), (3, "http://c/\n", big), (4, "d", "small"), (5, "e", "small"), (6, "f", None), (None, "g", big), (7, "h", "é" * 900)], "page_id long, url string, html string")
    folder = f"{C.shared_dir(spark)}/warc"
    index = A.write_warc(pages, folder)
    rows = {r["page_id"]: r for r in A.read_warc(index, folder, gap=0).collect()}
    assert len(rows) == 8 and [rows[i]["refers_to"] for i in (1, 2, 3, None)] == [3, 3, None, 3]
    assert rows[3]["payload"] == big.encode() and rows[1]["payload"] is None and rows[1]["payload_bytes"] == len(big)
    assert rows[7]["payload_digest"] == hashlib.sha1(("é" * 900).encode()).hexdigest() and rows[6]["payload_bytes"] == 0
    assert A.read_warc(index, folder, F.col("record_type") == "revisit").count() == 3
    assert A.read_warc(A.write_warc(pages.limit(0), folder + "0"), folder + "0").count() == 0
    raw = A.record(1, "u", b"x", hashlib.sha1(b"x").hexdigest(), None, False)
    assert A.parse(zlib.decompress(gzip.compress(raw), 31))["payload"] == b"x"


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(300)]
    odd = [(300, None), (301, [1.0, None] * 3), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (350, [0.0] * 6), (5, vectors[5][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors + odd[4:]]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for rows in (64, 8192):
        assert sorted(map(tuple, K.top_k(df, F.col("vec_id") % 50 == 0, block_rows=rows).collect())) == sorted(want)
    assert K.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
