"""Toxicity, decontamination, license scans and the pipeline: gradients, held-out accuracy and plain versions."""

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gnomon.llm import native as V
from gnomon.llm import toxicity as X
from gnomon.llm.decontaminate import contaminated
from gnomon.llm.license_scan import notices, scan

SF = "/root/testdata/sf0.001"


def words(a, n):
    return " ".join(f"{a}{i}" for i in range(n))


def test_toxicity(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, words(f"t{i % 7}", 40) + (" idiot scum " if i % 3 == 0 else " ") + words("z", 30)) for i in range(240)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = X.train(docs, labels, allowed=F.col("doc_id") % 4 != 2)
    rows = X.score_documents(docs.where("doc_id % 4 = 2"), model).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 3 == 0) for r in rows)
    scored = X.score_documents(odd_docs, model)
    assert scored.columns == [*odd_docs.columns, "score"] and scored.where("score between 0 and 1").count() == odd_docs.count()
    assert X.score_documents(no_docs, model).count() == 0 and X.train(no_docs, labels) is None


def test_gradients():
    """backward() against differences of forward(), parameter by parameter."""
    rng = np.random.default_rng(3)
    x = X.Inputs([b"alpha beta gamma delta " * 9, b"one two", b""])
    p = {k: v.astype(np.float64) for k, v in X.start(rng, np.zeros(X.WORDS), np.zeros(X.CHARS)).items()}
    windows, mask = x.windows(np.arange(len(x)))
    vectors = x.vectors(p).astype(np.float64)
    labels = rng.random(len(windows)) < 0.5

    def loss(p, vectors):
        out = X.forward(p, vectors, windows, mask)
        return float((np.log1p(np.exp(out)) - labels * out).sum())

    out, kept = X.forward(p, vectors, windows, mask, True)
    grads, d_in = X.backward(p, vectors, windows, mask, kept, 1 / (1 + np.exp(-out)) - labels)
    for name in ("Wf", "Uf", "bf", "Wb", "Ub", "bb", "A", "v", "w", "b"):
        flat = p[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            was, step = flat[i], 1e-3
            flat[i] = was + step
            up = loss(p, vectors)
            flat[i] = was - step
            down = loss(p, vectors)
            flat[i] = was
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=2e-3, rel=2e-2), name
    by_word = np.zeros_like(vectors)
    np.add.at(by_word, windows[mask], d_in[mask])
    for i, j in ((0, 1), (1, 9)):
        was = vectors[i, j]
        vectors[i, j] = was + 1e-3
        up = loss(p, vectors)
        vectors[i, j] = was - 1e-3
        assert by_word[i, j] == pytest.approx((up - loss(p, vectors)) / 2e-3, abs=2e-3, rel=2e-2)
        vectors[i, j] = was


def test_held_out_accuracy(spark):
    """Of the rows that fitting never sees, at sf0.1: 990 rows, 120 toxic."""
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = X.train(docs, labels, allowed=~held)
    judged = labels.where(held).join(docs.select("doc_id", "text"), "doc_id")
    rows = X.score_documents(judged, model).select("toxic", "score").collect()
    yes, score = np.array([r["toxic"] for r in rows]) == 1, np.array([r["score"] for r in rows])
    order = np.argsort(np.argsort(score)) + 1
    auc = (order[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())
    assert auc > 0.93 and (score[yes] >= 0.3).mean() > 0.7 and (score[~yes] >= 0.3).mean() < 0.03


def test_a_column_named_score(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0, "x")], "doc_id long, text string, Score double, id string")
    scored = X.score_documents(docs, None)
    assert scored.columns == ["doc_id", "text", "id", "score"] and scored.first()["score"] == 0.0


def grams(words, n=5):
    n = min(n, len(words))
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []


def weights(words):
    return {g: k * len(g) for g, k in collections.Counter(grams(words)).items()}


def contamination(docs, items, percent=80):
    """Every window of an item's size, cut off at the ends of the text, against every item."""
    out = {}
    for i, text in docs:
        words = (text or "").lower().split()
        for item, said in items:
            theirs = weights((said or "").lower().split())
            total, many = sum(theirs.values()), len((said or "").split())
            for start in range(1 - many, len(words)) if many else ():
                mine = weights(words[max(0, start) : start + many])
                both = sum(min(v, theirs.get(g, 0)) for g, v in mine.items())
                if both and 100 * both >= percent * (sum(mine.values()) + total - both):
                    out[i, item] = max(out.get((i, item), 0), round(both / (sum(mine.values()) + total - both), 6))
    return out


def edited(rnd, words, word):
    words = list(words)
    for _ in range(rnd.randint(0, 3)):
        kind, at = rnd.randint(0, 2), rnd.randrange(len(words))
        if kind == 0:
            words[at] = word()
        elif kind == 1:
            words.insert(at, word())
        elif len(words) > 2:
            words.pop(at)
    return words


def planted(seed, items, count=150):
    """Texts of random words, every third with an edited item somewhere."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    out = []
    for d in range(count):
        words = [word() for _ in range(rnd.randint(5, 90))]
        if d % 3 == 0:
            at = rnd.randint(0, len(words))
            words[at:at] = edited(rnd, rnd.choice(items).split(), word)
        out.append((d, " ".join(words)))
    return out


@pytest.mark.parametrize("bound", [1 << 16, 150])
def test_decontamination_is_brute_force(spark, bound, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    texts = [*(" ".join(word() for _ in range(rnd.randint(12, 45))) for _ in range(20)), "tiny item", " ".join(["la"] * 14)]
    docs, items = planted(5, texts), list(enumerate(texts))
    monkeypatch.setattr(V.found_places, "__defaults__", (bound,))  # in one part, and in several
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = contamination(docs, items)
    assert len(want) > 10 and {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()} == want


def test_decontamination(spark, odd_docs, no_docs):
    item = words("q", 20)
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, words("x", 50) + " " + item + " " + words("y", 9)), (2, item), (3, item.replace("q10 ", "")), (4, words("q", 8)), (5, "a tiny item b"), (6, None), (7, words("x", 80)), (2, item)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert {(1, 1), (2, 1), (5, 2)} <= got <= {(1, 1), (2, 1), (5, 2), (3, 1)}
    assert contaminated(odd_docs, items).count() == 0 and contaminated(no_docs, items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_licenses_are_brute_force(spark):
    """Windows of twice a template's size class, one every size class shingles, against all templates of the class."""
    templates = [(r["template_id"], r["license"], r["text"].lower().split()) for r in notices(spark).collect()]
    docs = planted(6, [" ".join(t) for _, _, t in templates], 120)
    docs += [(1000, None), (None, " ".join(templates[1][2]) + " tail"), (1001, " ".join(templates[8][2] * 3))]
    want = {}
    for i, text in docs:
        words = (text or "").split()
        for ident, name, said in templates:
            size = min(5, len(said))
            shingles = set(grams(said))
            stride = 1
            while stride < len(said) - size + 1:
                stride *= 2
            for number in range(0, max(1, len(words)), stride):
                window = words[number : number + 2 * stride + size - 1]
                mine = {" ".join(window[j : j + size]) for j in range(len(window) - size + 1)}
                both = len(mine & shingles)
                if 100 * both >= 80 * len(shingles):
                    best, n = want.get((i, ident), (0, 0))
                    want[i, ident] = (max(best, round(both / len(shingles), 6)), n + 1)
    got = {(r["doc_id"], r["template_id"]): (r["containment"], r["windows"]) for r in scan(spark.createDataFrame(docs, "doc_id long, text string"), notices(spark)).collect()}
    assert len(want) > 10 and got == want


def test_the_best_of_two_templates(spark):
    found = scan(spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string"), notices(spark))
    assert {r["license"]: r["best"] for r in found.collect()} == {"GPL-3.0": True, "GPL-2.0": False}


def test_licenses(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, words("x", 90) + "\nLicensed under CC BY-NC 4.0.\n" + words("y", 40)), (2, "Released under the MIT License."), (3, words("x", 30)), (4, None), (5, "all rights reserved.")], "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in scan(docs, notices(spark)).collect()} == {(1, "CC-BY-NC-4.0"), (2, "MIT"), (5, "proprietary")}
    assert scan(odd_docs, notices(spark)).count() == 0 and scan(no_docs, notices(spark)).count() == 0


def plain_links(docs):
    """Of each group of linked rows the first by (id, digest): rows as (id, text)."""
    import hashlib

    sets = [set(grams((t or "").lower().split())) for _, t in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for i, (d, t) in enumerate(docs):
        groups[top(i) if sets[i] else (d, t, i)].append(((-(1 << 63) if d is None else d, hashlib.md5((t or "").encode()).hexdigest()), i))
    return [docs[min(g)[1]] for g in groups.values()]


def plain_cut(docs, n=100):
    """Without bytes of strings that stand earlier, and without characters cut in two."""
    key = lambda d: -(1 << 63) if d is None else d
    first, out = {}, []
    for d, t in sorted(docs, key=lambda r: key(r[0])):
        raw = (t or "").encode()
        for j in range(len(raw) - n + 1):
            k = raw[j : j + n]
            first[k] = min(first.get(k, (key(d), j)), (key(d), j))
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - n + 1):
            if first[raw[j : j + n]] < (key(d), j):
                gone[j : j + n] = b"\1" * n
        out.append((d, bytes(x for x, g in zip(raw, gone) if not g).decode("utf-8", "ignore")))
    return out


def test_pipeline_is_its_plain_version(spark, tmp_path):
    """All stages but the network's against plain Python: texts after each, and the ids of the packed pieces."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    passage = " ".join(word() for _ in range(40))
    docs = []
    for d in range(40):
        words = [word() for _ in range(rnd.randint(30, 120))]
        if d % 4 == 1:
            words = docs[-1][1].split()
            words[rnd.randrange(len(words))] = word()
        if d % 5 == 2:
            words[10:10] = passage.split()
        if d % 7 == 3:
            words[5:5] = edited(rnd, rnd.choice(items).split(), word)
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (None, passage + " é" * 60), (102, "x y"), (103, "x y")]
    folder = f"file://{tmp_path}/sf"
    table = spark.createDataFrame([(d, t, None, None, None, "s", "i") for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, Score string, id string")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, table, folder)  # one label only: the score is 0 and all stay
    rows = lambda df: sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=repr)
    expected = docs
    for name, plain in (("toxicity", lambda x: x), ("ngram_jaccard", plain_links), ("suffix_dedup", plain_cut), ("decontamination", lambda x: [r for r in x if not contamination([r], list(enumerate(items)))])):
        if name != "toxicity":
            kept = dict(corpus_pipeline.STAGES)[name](spark, kept, folder)
        expected = plain(expected)
        assert kept.columns == table.columns and rows(kept) == sorted(((d, t or "") for d, t in expected), key=repr), name
    assert 20 < len(expected) < len(docs) and all(r["n_chars"] == len(r["text"]) for r in kept.collect())
    pieces = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = collections.Counter((d, len(ids)) for d, ids in ((d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in expected))
    whole = collections.defaultdict(int)
    for r in pieces:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {k: k[1] * n for k, n in want.items()} == dict(whole)
    crcs = {(d, 0, len(ids)): zlib.crc32(np.array(ids, "<u4").tobytes()) for d, ids in ((d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in expected)}
    assert all(crcs[r["doc_id"], 0, r["length"]] == r["ids_crc32"] for r in pieces if r["length"] == r["doc_tokens"])


def test_pipeline_of_nothing(spark, tmp_path, no_docs):
    folder = f"file://{tmp_path}/none"
    no_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
    pieces = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}


def test_pipeline_keeps_rows_with_null_and_repeated_ids(spark, odd_docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first()["text"]
    more = [(None, words("n", 30)), (None, words("m", 30)), (7, words("k", 30)), (7, words("p", 9) + " " + item), (None, ""), (None, None), (None, item + " " + words("r", 9))]
    docs = odd_docs.unionByName(spark.createDataFrame([(i, t, None, None, None, "b", "w") for i, t in more], odd_docs.schema)).repartition(3)
    text, long = " ".join(f"a{i}" for i in range(60)), " ".join(f"w{i}" for i in range(30_000))
    expected = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (8, long), (9, "x " * 400), (None, text), (10, "é" * 300), *more]
    kept = corpus_pipeline.ngram_jaccard(spark, docs, SF)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    assert kept.columns == docs.columns and pairs(kept) == sorted(expected, key=repr)
    cut = corpus_pipeline.suffix_dedup(spark, kept, SF)
    short = {9, 10}  # they repeat themselves; the item after "p0" stands earlier, in a row without id
    after = lambda rows: sorted(((i, t or "") for i, t in rows if i not in short and item not in (t or "") and not (t or "").startswith("p0 ")), key=repr)
    assert cut.count() == len(expected) and after(pairs(cut)) == after(expected)
    clean = corpus_pipeline.decontamination(spark, kept, SF)
    assert pairs(clean) == sorted([x for x in expected if item not in (x[1] or "")], key=repr)
