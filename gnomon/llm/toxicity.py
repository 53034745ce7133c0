"""Toxicity of documents by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into words (letters and digits; A-Z count as a-z) and into windows of WINDOW words, one every STRIDE words,
so that every word lies in two windows; all windows of all texts are scored. A word's input joins a learned vector and
the log odds of its own bucket with the means of both over the buckets of its character trigrams. Two gated recurrent
layers read a window from both ends, an attention layer weighs their states, and a logistic unit scores the sum. A
document's score is that of its worst window, passed through a logistic scale that is fitted to the labels.

Fitting uses a bounded sample: of each label at most `most` rows, those with the least hash of their id, with their
whole texts; the number of steps is fixed. It runs in one executor task, which returns the parameters alone, and is
repeated alike when that executor is lost. Scoring runs on all documents in the executors.

Defined cases: a null or empty text has one window of padding and gets the network's score for it. Rows without a label,
with a null label, or without a text are not used in fitting. Without rows of both labels the score is 0 for all. A
column of docs that is named like the score is replaced by it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.llm import common as C

WINDOW, STRIDE = 32, 16
MOST, STEPS, BATCH = 1500, 500, 64
WORDS, CHARS, E, H = 1 << 14, 1 << 12, 6, 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_D = 2 * (E + 1)


class Inputs:
    """The distinct words of some texts, their buckets, and the windows of the texts."""

    def __init__(self, texts: list[bytes]):
        plain = [x.translate(_LOWER) for x in texts]
        raw = np.frombuffer(b" ".join(plain) + b" ", np.uint8)
        of_doc, starts, lens, (h,) = C.spans(plain, raw, 1)
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        self.word = (h[one] >> np.uint64(64 - 14)).astype(np.int64)
        # Trigrams of the bytes of each distinct word with a space on either side.
        s, n = starts[one], lens[one]
        self.many = n
        at = np.arange(int(n.sum())) + np.repeat(s - (np.cumsum(n) - n), n)
        b = np.concatenate([[32], raw, [32]]).astype(np.uint64)
        self.grams = (C.mix(b[at] * np.uint64(65536) + b[at + 1] * np.uint64(256) + b[at + 2]) >> np.uint64(64 - 12)).astype(np.int64)
        # Of each window the text, the first word, and how many words follow; what lies beyond them is padding.
        count = np.diff(of_doc)
        wins = np.maximum(1, -(-(count - STRIDE) // STRIDE))
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), wins)
        first = (np.arange(len(self.doc)) - np.repeat(np.cumsum(wins) - wins, wins)) * STRIDE
        self.left = np.minimum(WINDOW, count[self.doc] - first)
        self.first = first + of_doc[:-1][self.doc]
        self.of_doc, self.back = of_doc, np.append(back, len(one)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.doc)

    def windows(self, pick: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words by window and step, with the index one beyond all for padding, and where there are words."""
        step = np.arange(WINDOW)
        mask = step < self.left[pick][:, None]
        return self.back[np.where(mask, self.first[pick][:, None] + step, len(self.back) - 1)], mask

    def outputs(self, p: dict, size: int = 4096) -> np.ndarray:
        """The network's output for every window."""
        vectors = self.vectors(p)
        return np.concatenate([forward(p, vectors, *self.windows(slice(a, a + size))) for a in range(0, len(self), size)])

    def vectors(self, p: dict) -> np.ndarray:
        """Inputs by distinct word, with zeros for padding."""
        out = np.zeros((len(self.word) + 1, _D), np.float32)
        if len(self.word):
            at = np.cumsum(self.many) - self.many
            n = self.many[:, None].astype(np.float32)
            out[:-1, : E + 1] = p["words"][self.word]
            out[:-1, E + 1 :] = np.add.reduceat(p["chars"][self.grams], at, axis=0) / n
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def start(rng: np.random.Generator, word_odds: np.ndarray, char_odds: np.ndarray) -> dict:
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    p = {"words": np.concatenate([normal(WORDS, E, scale=0.1), word_odds[:, None]], axis=1).astype(np.float32), "chars": np.concatenate([normal(CHARS, E, scale=0.1), char_odds[:, None]], axis=1).astype(np.float32)}
    for d in "fb":
        p |= {f"W{d}": normal(_D, 3 * H, scale=0.3), f"U{d}": normal(H, 3 * H, scale=0.3), f"b{d}": np.zeros(3 * H, np.float32)}
    return p | {"A": normal(2 * H, H, scale=0.3), "v": normal(H, scale=0.3), "w": normal(2 * H, scale=0.3), "b": np.zeros(1, np.float32)}


def forward(p: dict, vectors: np.ndarray, windows: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Scores (before the logistic) of windows; with keep, also what backward() needs."""
    n, steps = windows.shape
    states, held = np.empty((n, steps, 2 * H), np.float32), {}
    for k, d in enumerate("fb"):
        x = vectors @ p[f"W{d}"] + p[f"b{d}"]
        h, kept = np.zeros((n, H), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gx, gh = x[windows[:, t]], h @ p[f"U{d}"]
            g = _sigmoid(gx[:, : 2 * H] + gh[:, : 2 * H])
            z, r = g[:, :H], g[:, H:]
            m = np.tanh(gx[:, 2 * H :] + r * gh[:, 2 * H :])
            new = np.where(mask[:, t : t + 1], m + z * (h - m), h)
            if keep:
                kept.append((t, h, z, r, m, gh[:, 2 * H :]))
            h = new
            states[:, t, k * H : (k + 1) * H] = h
        held[d] = kept
    a = np.tanh(states @ p["A"])
    e = np.where(mask, a @ p["v"], -1e9)
    e[:, 0] = np.where(mask.any(axis=1), e[:, 0], 0)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    alpha = e / e.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", alpha, states)
    out = pooled @ p["w"] + p["b"][0]
    return (out, (states, held, a, alpha, pooled)) if keep else out


def backward(p: dict, inputs: np.ndarray, windows: np.ndarray, mask: np.ndarray, kept, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters of the layers, and of the inputs by window and step."""
    states, held, a, alpha, pooled = kept
    g = {"w": pooled.T @ slope, "b": slope.sum(keepdims=True)}
    d_pool = slope[:, None] * p["w"]
    d_alpha = np.einsum("nh,nth->nt", d_pool, states)
    d_e = np.where(mask, alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True)), 0)
    d_a = d_e[:, :, None] * p["v"] * (1 - a * a)
    g["v"] = np.einsum("nt,nth->h", d_e, a)
    g["A"] = np.einsum("nti,ntj->ij", states, d_a)
    d_states = alpha[:, :, None] * d_pool[:, None] + d_a @ p["A"].T
    d_in = np.zeros((*windows.shape, _D), np.float32)
    for k, d in enumerate("fb"):
        W, U = p[f"W{d}"], p[f"U{d}"]
        gU, gW, gb, dh = np.zeros_like(U), np.zeros_like(W), np.zeros(3 * H, np.float32), np.zeros((len(windows), H), np.float32)
        for t, h, z, r, m, hm in reversed(held[d]):
            dh = dh + d_states[:, t, k * H : (k + 1) * H]
            on = mask[:, t : t + 1]
            dn = np.where(on, dh, 0)
            dm = dn * (1 - z) * (1 - m * m)
            dz = dn * (h - m) * z * (1 - z)
            dr = dm * hm * r * (1 - r)
            gx = np.concatenate([dz, dr, dm], axis=1)
            gh = np.concatenate([dz, dr, dm * r], axis=1)
            gU += h.T @ gh
            x = inputs[windows[:, t]]
            gW += x.T @ gx
            gb += gx.sum(axis=0)
            d_in[:, t] += gx @ W.T
            dh = np.where(on, dn * z, dh) + gh @ U.T
        g |= {f"U{d}": gU, f"W{d}": gW, f"b{d}": gb}
    return g, d_in


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> dict | None:
    """The parameters, with the logistic scale from a document's worst window to its score; None without both labels."""
    labels = np.asarray(labels, bool)
    if not labels.any() or labels.all():
        return None
    rng, x = np.random.default_rng(seed), Inputs(texts)
    at = np.cumsum(x.many) - x.many

    def holders() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct words and their texts, some texts at a time."""
        for a in range(0, len(texts), 64):
            cut = x.of_doc[a : a + 65]
            pair = np.unique(np.repeat(np.arange(len(cut) - 1), np.diff(cut)) * len(x.back) + x.back[cut[0] : cut[-1]])
            yield pair % len(x.back), a + pair // len(x.back)

    # Log odds of buckets, by documents that hold them.
    words, chars = np.zeros((2, WORDS)), np.zeros((2, CHARS))
    for word, doc in holders():
        many = x.many[word]
        gram = x.grams[np.arange(int(many.sum())) + np.repeat(at[word] - (np.cumsum(many) - many), many)]
        for table, bucket, of in ((words, x.word[word], doc), (chars, gram, np.repeat(doc, many))):
            pair = np.unique(of * table.shape[1] + bucket)
            np.add.at(table, (labels[pair // table.shape[1]].astype(int), pair % table.shape[1]), 1)
    n = np.array([(~labels).sum(), labels.sum()])[:, None]
    odds = lambda t: (np.diff(np.log((t + 0.5) / (n + 1)), axis=0)[0]).clip(-4, 4) / 2
    p = start(rng, odds(words), odds(chars))
    layers = [k for k in p if k not in ("words", "chars")]
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    # A document stands for its worst window, at first by its words' odds, later by the network; clean ones for random ones too.
    vectors = x.vectors(p)
    worst = np.empty(len(x), np.float32)
    for a in range(0, len(x), 4096):
        ids, mask = x.windows(slice(a, a + 4096))
        worst[a : a + 4096] = np.where(mask, vectors[ids, E], 0).max(axis=1)
    begins = np.flatnonzero(np.diff(x.doc, prepend=-1))
    sizes = np.diff(np.append(begins, len(x.doc)))
    toxic, clean = np.flatnonzero(labels), np.flatnonzero(~labels)
    for step in range(steps):
        if step % 125 == 0:
            if step:
                worst = x.outputs(p)
            top = np.lexsort((-worst, x.doc))[begins]
        docs = np.concatenate([rng.choice(toxic, BATCH // 2), rng.choice(clean, BATCH // 2)])
        pick = top[docs]
        other = rng.random(BATCH) < 0.5
        other[: BATCH // 2] = False
        pick = np.where(other, begins[docs] + (rng.random(BATCH) * sizes[docs]).astype(np.int64), pick)
        windows, mask = x.windows(pick)
        ids = np.unique(windows[mask]) if mask.any() else np.empty(0, np.int64)
        vectors = x.vectors(p) if step % 125 == 0 else vectors
        at_id = x.many[ids].cumsum() - x.many[ids]
        grams = x.grams[np.arange(int(x.many[ids].sum())) + np.repeat(at[ids] - at_id, x.many[ids])]
        vectors[ids, : E + 1] = p["words"][x.word[ids]]
        vectors[ids, E + 1 :] = np.add.reduceat(p["chars"][grams], at_id, axis=0) / x.many[ids][:, None] if len(ids) else 0
        out, kept = forward(p, vectors, windows, mask, True)
        slope = ((_sigmoid(out) - labels[docs]) / BATCH).astype(np.float32)
        g, d_in = backward(p, vectors, windows, mask, kept, slope)
        by_word = np.zeros((len(vectors), _D), np.float32)
        np.add.at(by_word, windows[mask], d_in[mask])
        for key, rows, grad in (("words", x.word[ids], by_word[ids, : E + 1]), ("chars", grams, np.repeat(by_word[ids, E + 1 :] / x.many[ids][:, None], x.many[ids], axis=0))):
            full = g[key] = np.zeros_like(p[key])
            np.add.at(full, rows, grad)
            full[:, E] = 0  # the odds stay as they were counted
        rate = 0.02 * min(1, (steps - step) / (steps / 2))
        for key in (*layers, "words", "chars"):
            first[key] = 0.9 * first[key] + 0.1 * g[key]
            second[key] = 0.99 * second[key] + 0.01 * g[key] * g[key]
            p[key] = p[key] - np.float32(rate) * (first[key] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[key] / (1 - 0.99 ** (step + 1))) + 1e-6)
            p[key] = p[key].astype(np.float32)
    worst = np.maximum.reduceat(x.outputs(p), begins)
    # Worst windows become probabilities by a logistic fit, with both labels of equal weight.
    scale, shift = 1.0, 0.0
    weight = np.where(labels, 0.5 / labels.sum(), 0.5 / (~labels).sum())
    for _ in range(200):
        q = _sigmoid(scale * worst + shift)
        e, s = weight * (q - labels), weight * q * (1 - q) + 1e-9
        hess = np.array([[(s * worst * worst).sum() + 1e-3, (s * worst).sum()], [(s * worst).sum(), s.sum() + 1e-3]])
        move = np.linalg.solve(hess, [(e * worst).sum() + 1e-3 * (scale - 1), e.sum() + 1e-3 * shift])
        scale, shift = max(0.05, scale - 0.5 * move[0]), shift - 0.5 * move[1]
    return p | {"scale": np.float32(scale), "shift": np.float32(shift)}


def score(p: dict, texts: list[bytes]) -> np.ndarray:
    """Scores of texts, 0 to 1, from all of their windows."""
    out = []
    for a, b in C.chunks(texts):
        x = Inputs(texts[a:b])
        worst = np.maximum.reduceat(x.outputs(p, 2048), np.flatnonzero(np.diff(x.doc, prepend=-1)))
        out.append(_sigmoid(p["scale"] * worst.astype(np.float64) + p["shift"]))
    return np.concatenate(out) if out else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", ident: str = "doc_id", text: str = "text", most: int = MOST, allowed: Column | None = None) -> dict | None:
    """Fits on at most `most` rows of each label, of those that `allowed` (of the labels' columns) admits."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull() & (F.lit(True) if allowed is None else allowed)).select(F.col(ident).cast("long").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    key = F.xxhash64("id")
    chosen = known.where("label = 1").orderBy(key, "id").limit(most).unionByName(known.where("label = 0").orderBy(key, "id").limit(most))
    # At most 2 * most rows: small enough for any executor.
    texts = docs.where(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").withColumn("task", F.lit(0))

    def run(rows: pa.Table) -> pa.Table:
        rows = sorted(zip(rows.column("id").to_pylist(), rows.column("label").to_pylist(), rows.column("text").to_pylist(), strict=True))
        model = fit([r[2].encode() for r in rows], np.array([r[1] for r in rows], bool))
        C.tidy()
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = sample.groupBy("task").applyInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def score_documents(docs: DataFrame, model: dict | None, text: str = "text", into: str = "score") -> DataFrame:
    """All columns of docs with the score, from 0 to 1."""
    docs = docs.select([c for c in docs.columns if c.lower() != into.lower()])
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)

    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if x is None else x.encode() for x in batch.column(at).to_pylist()]
            C.tidy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(model.value, texts), pa.float64())], names=[*names, "score_"])

    from pyspark.sql import types as T

    schema = T.StructType([*wide.schema.fields, T.StructField("score_", T.DoubleType())])
    return wide.mapInArrow(run, schema).toDF(*docs.columns, into)
