"""Toxicity: a linear softmax over the average of subword-bag word vectors, both trained together in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the whole word, hashed into a fixed table, so an
unseen misspelling shares most of its vector with the words it resembles. Every n-gram has a vector; in the average it weighs
by how far its document counts in the two classes differ (a z value, either sign), so common n-grams that tell nothing add
little noise. The model is linear after the average, so a trained word is one number: scoring looks words up and averages.
Inputs are texts and labels only.

Training runs in one executor task on a bounded sample of labelled documents, each with its whole text; only one number a
bucket comes back. Null and empty texts score by the bias alone; repeated rows and null ids are scored each; labels that
are null or not 0 or 1 are ignored; other columns pass through, and one named like the score is replaced.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

#: Labelled documents used to fit, at most, per class (the bound on the training sample; of each, the whole text counts).
FIT_DOCS = 4000
BUCKETS, DIM, NGRAMS = 1 << 17, 16, (3, 4, 5)
THRESHOLD = 0.7
#: A bucket weighs (z^2 / (z^2 + MID_Z^2))^2; GAIN scales the average (toxic words are a few in 100).
MID_Z, GAIN = 6.0, 30.0
#: Words remembered per worker, characters of such a word at most, and subwords that fitting documents hold at once at most.
CACHE, CACHE_CHARS, HELD = 300_000, 64, 20_000_000
#: Characters of texts whose new words are looked up together, and characters that such a look-up holds as arrays.
PIECE, ARRAY = 1_000_000, 50_000
_WORD = re.compile(r"\w+")
#: The table of zlib's CRC-32: what one byte does to the register.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def subwords(word: str) -> np.ndarray:
    """Buckets of a word: itself and all its n-grams with end marks, however long it is."""
    w = f"<{word}>"
    grams = itertools.chain([w], (w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)))
    return np.fromiter((zlib.crc32(g.encode()) % BUCKETS for g in grams), np.int32)


def means(words: list[str], scores: np.ndarray) -> np.ndarray:
    """``scores[subwords(w)].mean()`` of words of one length, with the n-grams of all of them hashed together."""
    size = len(words[0]) + 2
    marked = [f"<{w}>" for w in words]
    a = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).reshape(-1, size)
    n = 1 + (a > 0x7F) + (a > 0x7FF) + (a > 0xFFFF).astype(np.uint32)  # bytes of each character in UTF-8
    most = int(n.max())
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[n] if most > 1 else np.uint32(0)
    planes = [((0x80 if j else lead) | (a >> (6 * np.maximum(n - 1, j) - 6 * j)) & (0x3F if j else 0x7F)).astype(np.uint32) for j in range(most)]
    c, grams = np.full(a.shape, 0xFFFFFFFF, np.uint32), [np.array([zlib.crc32(m.encode()) for m in marked], np.uint32)[:, None]]
    for k in range(min(max(NGRAMS), size)):
        c = c[:, : size - k]
        for j, byte in enumerate(planes):
            now = _CRC[(c ^ byte[:, k:]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
            c = now if j == 0 else np.where(n[:, k:] > j, now, c)
        if k + 1 in NGRAMS:
            grams.append(~c)
    return scores[np.concatenate(grams, axis=1) % np.uint32(BUCKETS)].mean(axis=1)


def held_out(doc_id):
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


class Model:
    """One number a bucket (its vector times the difference of the two class weights, scaled) and the bias."""

    def __init__(self, scores: np.ndarray, bias: float):
        self.scores, self.bias = scores, bias

    @classmethod
    def constant(cls, bias: float) -> Model:
        return cls(np.zeros(BUCKETS, np.float32), bias)


def importance(docs, y: np.ndarray) -> np.ndarray:
    """Weight of every bucket from the numbers of documents of each class that hold it."""
    n1, n0 = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    count = np.zeros((2, BUCKETS))
    for u, k in zip(docs, y, strict=True):
        count[k, u] += 1
    p = count.sum(0) / (n1 + n0)
    z2 = (count[1] / n1 - count[0] / n0) ** 2 / np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12)
    return ((z2 / (z2 + MID_Z**2)) ** 2).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, epochs: int = 10, rate: float = 0.1, seed: int = 1) -> Model:
    """Train embedding table and softmax together by Adagrad on single documents in random order.

    The bias is then moved so that THRESHOLD falls on the cut of the fitting documents with the best recall less ten
    times the false-positive rate.
    """
    rng = np.random.default_rng(seed)
    known: dict[str, np.ndarray] = {}
    y = np.asarray(labels, int)

    def parts(w):
        if len(w) > CACHE_CHARS:
            return subwords(w)
        if w not in known:
            known[w] = subwords(w)
        return known[w]

    def bag(t):
        words = _WORD.findall(t.lower())
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        found = [parts(w) for w in words]
        u, inv = np.unique(np.concatenate(found), return_inverse=True)
        val = np.concatenate([np.full(len(p), 1 / len(p)) for p in found]) / len(words)
        return u, np.bincount(inv, val).astype(np.float32)

    held, space = {}, HELD

    def buckets():
        nonlocal space
        for i, t in enumerate(texts):
            u, v = bag(t)
            if len(u) <= space:  # the others are made again in every round
                held[i], space = (u, v), space - len(u)
            yield u

    gain = GAIN * importance(buckets(), y)
    known.clear()
    for u, v in held.values():
        v *= gain[u]

    def weighted(i):
        if i in held:
            return held[i]
        u, v = bag(texts[i])
        return u, v * gain[u]

    table = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    weight, bias = rng.random((DIM, 2), np.float32) - 0.5, np.zeros(2, np.float32)
    seen_t, seen_w, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full_like(weight, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            u, v = weighted(i)
            h = v @ table[u] if len(u) else np.zeros(DIM, np.float32)
            z = h @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            if len(u):
                g = v[:, None] * (weight @ p)
                seen_t[u] += (g * g).sum(1)
                table[u] -= (rate / np.sqrt(seen_t[u]))[:, None] * g
                g = np.outer(h, p)
                seen_w += g * g
                weight -= rate * g / np.sqrt(seen_w)
            seen_b += p * p
            bias -= 0.1 * p / np.sqrt(seen_b)
    scores, b = table @ (weight[:, 1] - weight[:, 0]), float(bias[1] - bias[0])
    logit = np.array([float(v @ scores[u]) + b if len(u) else b for u, v in map(weighted, range(len(texts)))])
    if (y == 1).any() and (y == 0).any():
        levels = np.unique(logit)
        best = [((logit >= c)[y == 1].mean() - 10 * (logit >= c)[y == 0].mean(), i) for i, c in enumerate(levels)]
        i = max(best)[1]
        cut = (levels[i] + levels[i - 1]) / 2 if i else levels[0]
        b += float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return Model((scores * gain).astype(np.float32), b)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = FIT_DOCS) -> Model:
    """Fit on labelled rows outside the held-out third: per class the ``max_docs`` rows first in hash order.

    Where only one class is known, every score is that class's constant.
    """
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    lab = lab.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [lab.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for k in (0, 1)]
    chosen = picks[0].unionByName(picks[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        if not rows:
            return
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1] or ""))
        y = np.array([r[2] for r in rows])
        model = fit([r[1] or "" for r in rows], y) if len(set(y.tolist())) == 2 else Model.constant(4.0 if y[0] else -4.0)
        yield pa.RecordBatch.from_arrays([pa.array([model.scores.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["scores", "bias"])

    # Ids first (2 x max_docs rows at most), so texts are read behind a broadcast filter and few of them move.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "text", "toxic")
    with small_batches(docs.sparkSession):
        got = texts.repartition(1).mapInArrow(lean(run), "scores binary, bias double").collect()
    return Model(np.frombuffer(got[0].scores, np.float32), got[0].bias) if got else Model.constant(-4.0)


class _Words(dict):
    def __init__(self, scores):
        super().__init__()
        self.scores = scores

    def learn(self, texts: list[list[str]]) -> None:
        """Look up the new words of ``texts`` together, as many as are remembered at most."""
        words = {w for w in set().union(*texts) if len(w) <= CACHE_CHARS}
        new = words.difference(self)
        if len(self) + len(new) > CACHE:
            self.clear()
            new = words
        by: dict[tuple, list[str]] = {}
        for w in itertools.islice(new, CACHE):
            by.setdefault((len(w), w.isascii()), []).append(w)
        for (size, _), found in by.items():
            step = max(1, ARRAY // (size + 2))
            for i in range(0, len(found), step):
                self.update(zip(found[i : i + step], means(found[i : i + step], self.scores).tolist(), strict=True))

    def __missing__(self, w):
        v = float(self.scores[subwords(w)].mean())
        if len(w) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[w] = v
        return v


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``; every word of every text counts, an empty or null text scores by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.scores, model.bias))  # BUCKETS floats, a fixed size
    rest = docs.select(*[c for c in docs.columns if c != out])
    schema = rest.withColumn(out, F.lit(0.0)).schema
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, bias = shared.value
        words = _Words(scores)
        for b in batches:
            logit, texts, chars = [], [], 0
            for i, t in enumerate(b.column(at)):
                t = t.as_py() or ""
                texts.append(_WORD.findall(t.lower()))
                chars += len(t)
                if chars >= PIECE or i == b.num_rows - 1:
                    words.learn(texts)
                    logit += [bias + (sum(map(words.__getitem__, x)) / len(x) if x else 0.0) for x in texts]
                    texts, chars = [], 0
            p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, out])

    return rest.mapInArrow(lean(run), schema)
