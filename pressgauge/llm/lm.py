"""Masked pseudo-likelihood: a window network, trained in numpy, predicts every token from both sides.

The two words on each side of a token (not the token) are embedded and joined, one tanh layer follows, and a two-level
softmax gives the token's class and the word within the class. Summed log-probabilities score a document.

Word counts cover the whole corpus. The network starts from a short fit on a bounded sample; then every task goes once
over all its documents from there, and the tasks' parameters are averaged by tokens, so training covers every token and
what is gathered grows with the input. Words outside the table share hashed entries; the probability of such an entry is
split among its words by their counts in all texts, so every word of the corpus has its own.

Texts are read once. Each task numbers the words of a block of documents as they come; the blocks' word lists (not their
tokens) are shuffled to meet the counts, and go back to their block as a table from number to entry. Training and scoring
read the encoded documents.

One rule finds words everywhere: runs of ``\\w`` of the lower-case text. Null and empty texts have no tokens and a
log-likelihood of 0; repeated rows and null ids are scored each; ties in the vocabulary go by word; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, released, saved, summed, vector_rows

#: Words with an entry, hashed entries for all others, words a class, embedding and hidden sizes, words on each side.
VOCAB, HASHED, PER_CLASS, DIM, HIDDEN, SIDE = 4000, 96, 64, 16, 32, 2
#: Documents of the starting fit and, of each, runs of words and words a run (its bound), tokens of a training step, rate.
WARM_DOCS, RUNS, RUN, STEP, RATE = 300, 20, 100, 4096, 0.02
SIZE = VOCAB + HASHED  # a multiple of PER_CLASS
CLASSES = SIZE // PER_CLASS
PAD = SIZE
_WORD = re.compile(r"\w+")
#: Different words of a block of documents, and tokens of the rows that leave a task together, about.
HELD, SENT = 200_000, 1_000_000


def _folded(c: str) -> str:
    return c.lower() if _WORD.match(c) else " "


#: The rule for texts of Latin-1 characters, whose lower-case forms are single ones of that set: what is no word is blank.
_LATIN = "".join(_folded(chr(c)) for c in range(256)).encode("latin-1")


def words_of(text: str | None) -> list[str]:
    try:
        return (text or "").encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


class Vocabulary:
    """Entries of the most frequent words; ``counts`` (word, n) of all words stays on the driver's side of a broadcast."""

    def __init__(self, words: list[str], counts: DataFrame | None = None):
        self.ids = {w: i for i, w in enumerate(words)}
        self.counts = counts

    def __getstate__(self):
        return {"ids": self.ids, "counts": None}

    def __call__(self, text: str | None) -> np.ndarray:
        """Entries of the words of a text."""
        found = ((self.ids.get(w), w) for w in words_of(text))
        return np.array([VOCAB + zlib.crc32(w.encode()) % HASHED if i is None else i for i, w in found], np.int32)


def contexts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, context ids of shape (n, 2 SIDE)) of all documents; outside a document is PAD."""
    gap = np.full(SIDE, PAD, np.int32)
    flat = np.concatenate([gap, *[x for d in docs for x in (d, gap)]])
    at = np.flatnonzero(flat != PAD)
    return flat[at], np.stack([flat[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1)


class Network:
    names = ("emb", "w1", "b1", "wc", "bc", "ww", "bw")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        share = (counts + 1).reshape(CLASSES, PER_CLASS).astype(np.float64)
        by_class = share.sum(1)
        return cls({
            "emb": r(SIZE + 1, DIM), "w1": r(2 * SIDE * DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "wc": r(HIDDEN, CLASSES),
            "bc": np.log(by_class / by_class.sum()).astype(np.float32), "ww": r(CLASSES, HIDDEN, PER_CLASS),
            "bw": np.log(share / by_class[:, None]).astype(np.float32),
        })

    def _hidden(self, ctx):
        x = self.p["emb"].take(ctx, 0).reshape(len(ctx), -1)
        h = np.ones((len(ctx), HIDDEN + 1), x.dtype)  # the last column meets the biases
        z = x @ self.p["w1"]
        z += self.p["b1"]
        np.tanh(z, out=h[:, :HIDDEN])
        return x, h

    def _heads(self):
        """Weights of classes and of words, each over its biases."""
        p = self.p
        return np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["ww"], p["bw"][:, None]], 1)

    @staticmethod
    def _softmax(z, bound):
        """(exponentials, sums) of rows of logits, in place. Logits under ``bound`` need no maximum taken off."""
        if bound > 60:
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], np.float32)

    @staticmethod
    def _by_class(tokens, ctx):
        """Rows in order of class: (order, class, word in class, contexts, bounds of the classes present)."""
        k = (tokens // PER_CLASS).astype(np.uint16)  # numpy sorts 16-bit integers by radix
        order = np.argsort(k, kind="stable")
        k, t = k[order], tokens[order]
        cut = np.searchsorted(k, np.arange(CLASSES + 1)).tolist()
        return order, k, t % PER_CLASS, ctx.take(order, 0), [(c, cut[c], cut[c + 1]) for c in range(CLASSES) if cut[c] < cut[c + 1]]

    @staticmethod
    def _word_logits(h, ww, groups):
        """Logits of the words of each row's class: one product a class, one row a token."""
        z = np.empty((len(h), PER_CLASS), h.dtype)
        for g, i, j in groups:
            np.matmul(h[i:j], ww[g], out=z[i:j])
        return z

    def _bounds(self):
        """Largest logits that |h| <= 1 allows, of classes and of words."""
        p = self.p
        return tuple(float((np.abs(p[w]).sum(-2) + np.abs(p[b])).max()) for w, b in (("wc", "bc"), ("ww", "bw")))

    def log_probs(self, tokens: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        out, (wc, ww), (bound_c, bound_w) = np.empty(len(tokens), np.float64), self._heads(), self._bounds()
        for at in range(0, len(tokens), STEP):
            order, k, w, c, groups = self._by_class(tokens[at : at + STEP], ctx[at : at + STEP])
            _, h = self._hidden(c)
            lp = np.zeros(len(k))
            for z, which, bound in ((h @ wc, k, bound_c), (self._word_logits(h, ww, groups), w, bound_w)):
                if bound > 60:
                    z -= z.max(1, keepdims=True)
                lp += z[np.arange(len(k)), which]
                lp -= np.log(self._softmax(z, 0)[1])
            out[at + order] = lp
        return out

    def step(self, tokens: np.ndarray, ctx: np.ndarray, seen: dict[str, np.ndarray], rate: float = RATE) -> None:
        """One Adagrad step on the mean log-loss of a batch."""
        n, p, (wc, ww), (bound_c, bound_w) = len(tokens), self.p, self._heads(), self._bounds()
        _, k, w, ctx, groups = self._by_class(tokens, ctx)
        x, h = self._hidden(ctx)
        rows = np.arange(n)

        def errors(z, right, bound):
            e, s = self._softmax(z, bound)
            e *= (1 / (s * n))[:, None]
            e[rows, right] -= np.float32(1 / n)
            return e

        d = errors(h @ wc, k, bound_c)
        e = errors(self._word_logits(h, ww, groups), w, bound_w)
        back, of_c, of_w = d @ p["wc"].T, h.T @ d, np.zeros_like(ww)
        for g, i, j in groups:
            back[i:j] += e[i:j] @ p["ww"][g].T
            np.matmul(h[i:j].T, e[i:j], out=of_w[g])
        grads = {"wc": of_c[:-1], "bc": of_c[-1], "ww": of_w[:, :-1], "bw": of_w[:, -1]}
        h = h[:, :HIDDEN]
        back *= 1 - h * h
        grads |= {"w1": x.T @ back, "b1": back.sum(0)}
        dx = (back @ p["w1"].T).reshape(-1, DIM)
        ids = ctx.ravel().astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        times = np.bincount(ids, minlength=SIZE + 1)
        met = np.flatnonzero(times)
        dealt = dx.take(order, 0)
        dealt = dealt.view(f"c{2 * dx.itemsize}") if DIM % 2 == 0 else dealt  # two numbers are added at once
        summed = np.add.reduceat(dealt, (np.cumsum(times) - times)[met]).view(dx.dtype)
        seen["emb"][met] += summed * summed
        p["emb"][met] -= rate * summed / np.sqrt(seen["emb"][met])
        for name, grad in grads.items():
            square = grad * grad
            seen[name] += square
            np.sqrt(seen[name], out=square)
            grad *= rate
            grad /= square
            p[name] -= grad

    def fresh(self) -> dict[str, np.ndarray]:
        return {k: np.full_like(v, 1e-8) for k, v in self.p.items()}

    def train(self, docs: Iterator[np.ndarray], epochs_of_buffer: int = 1) -> int:
        """Steps over documents in order; returns the tokens seen."""
        seen, held, n, total = self.fresh(), [], 0, 0
        for d in docs:
            if len(d):
                held.append(d)
                n += len(d)
            if n >= 8 * STEP:
                total += self._pass(held, seen, epochs_of_buffer)
                held, n = [], 0
        return total + (self._pass(held, seen, epochs_of_buffer) if held else 0)

    def _pass(self, held, seen, epochs):
        tokens, ctx = contexts(held)
        rng = np.random.default_rng(len(tokens))
        for _ in range(epochs):
            order = rng.permutation(len(tokens))
            for at in range(0, len(tokens), STEP):
                rows = order[at : at + STEP]
                self.step(tokens[rows], ctx.take(rows, 0), seen)
        return len(tokens)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.names])

    def like(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k in self.names:
            out[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return Network(out)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_BLOCK = "block long, doc_id long, tokens binary, word string, number int, n long"
_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.binary()), ("word", pa.string()), ("number", pa.int32()), ("n", pa.int64())])


def numbered(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents as numbers of words (``tokens``), and the word list of each block with its counts (``word`` is not null)."""

    def batch(block, **cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()) if f.name == "block" else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, known, times = TaskContext.get().partitionId() << 32, _Numbers(), []
        ids, held, size = [], [], 0

        def documents():
            out = batch(block, doc_id=ids, tokens=[x.tobytes() for x in held])
            times.append(np.bincount(np.concatenate(held))) if size else None
            return out

        def word_list():
            n = np.zeros(len(known), np.int64)
            for t in times:
                n[: len(t)] += t
            return batch(block, word=list(known), number=np.arange(len(known), dtype=np.int32), n=n)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words_of(t.as_py())
                ids.append(i)
                held.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                size += len(w)
                if size >= SENT or len(known) >= HELD or len(ids) >= 5000:
                    yield documents()
                    ids, held, size = [], [], 0
                    if len(known) >= HELD:
                        yield word_list()
                        block, known, times = block + 1, _Numbers(), []
        if ids:
            yield documents()
        if known:
            yield word_list()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _BLOCK)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus counts of words, combined within a block of documents before anything is sent."""
    return _counts(numbered(docs.withColumn("__id", F.lit(0)), text_col, "__id"))


def _counts(blocks: DataFrame) -> DataFrame:
    return blocks.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


def _entry(word):
    return F.pmod(F.crc32(word.cast("binary")), F.lit(HASHED)).cast("int")


def most_frequent(counts: DataFrame, k: int) -> list:
    """The ``k`` words of highest count, ties by word. Levels of counts (32 a power of two) are counted first, so few more than
    ``k`` words reach the sort, however many tasks hold the counts."""
    level = F.floor(F.log2("n") * 32)
    seen, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        seen, least = seen + r.words, r.level
        if seen >= k:
            break
    return counts.filter(level >= least).orderBy(F.desc("n"), "word").limit(k).collect() if least is not None else []


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The VOCAB most frequent words (ties by word) and the counts of all entries, hashed ones included."""
    top = most_frequent(counts, VOCAB)
    out = np.zeros(SIZE)
    out[: len(top)] = [r.n for r in top]
    for r in counts.groupBy(_entry(F.col("word")).alias("h")).agg(F.sum("n").alias("n")).collect():
        out[VOCAB + r.h] = r.n
    for r in top:
        out[VOCAB + zlib.crc32(r.word.encode()) % HASHED] -= r.n
    return Vocabulary([r.word for r in top], counts), out


class Corpus:
    """Encoded documents ``rows`` (doc_id, tokens, within), the vocabulary, and the counts of its entries.

    ``tokens`` are 16-bit entries; ``within`` sums log(count of the word / count of its entry) over words of hashed entries.
    """

    def __init__(self, rows: DataFrame, vocab: Vocabulary, counts: np.ndarray | None):
        self.rows, self.vocab, self.counts = rows, vocab, counts


def encode(docs: DataFrame, vocab: Vocabulary | None = None, text_col: str = "text", id_col: str = "doc_id") -> Corpus:
    """Documents by the entries of ``vocab``, or of a vocabulary of their own. A word that a given vocabulary's texts do not
    hold counts as one more word seen once."""
    blocks, counts = saved(numbered(docs, text_col, id_col), "blocks"), None
    if vocab is None:
        vocab, counts = vocabulary(saved(_counts(blocks), "words"))
    spark, h = docs.sparkSession, _entry(F.col("word"))
    top = spark.createDataFrame(list(vocab.ids.items()), "word string, entry int")  # VOCAB rows at most
    words = vocab.counts.join(F.broadcast(top), "word", "left")
    totals = F.broadcast(words.filter("entry is null").groupBy(h.alias("h")).agg(F.sum("n").alias("in_entry")))  # HASHED rows
    lists = blocks.filter("word is not null").select("block", "word", "number").join(words, "word", "left").withColumn("h", h).join(totals, "h", "left")
    share = F.coalesce(F.log(F.col("n") / F.col("in_entry")), -F.log(F.coalesce("in_entry", F.lit(0)) + 1))
    table = lists.select("block", F.lit(0).alias("role"), "number", F.coalesce("entry", F.col("h") + VOCAB).alias("entry"), F.when(F.col("entry").isNull(), share).otherwise(0.0).alias("share"))
    texts = blocks.filter("word is null").select("block", F.lit(1).alias("role"), "doc_id", "tokens")
    both = table.unionByName(texts, allowMissingColumns=True).select("block", "role", "number", "entry", "share", "doc_id", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        at = entry = within = None
        for b in batches:
            block, role = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (role[1:] != role[:-1])])) if len(block) else []
            for i, j in zip(cut, [*cut[1:], len(block)], strict=True):
                if role[i] == 0:
                    if at != block[i]:
                        at, held, entry = block[i], [], None
                    held.append([b.column(k).slice(i, j - i).to_numpy() for k in (2, 3, 4)])
                    continue
                if at != block[i]:  # a block without a word
                    at, held, entry = block[i], [[np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)]], None
                if entry is None:
                    number, e, w = (np.concatenate(x) for x in zip(*held, strict=True))
                    entry, within = np.zeros(len(number), np.uint16), np.zeros(len(number))
                    entry[number], within[number] = e, w
                numbers = [np.frombuffer(t.as_buffer(), np.int32) if t.as_buffer().size else np.zeros(0, np.int32) for t in b.column(6).slice(i, j - i)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(5).slice(i, j - i), pa.array([entry[x].tobytes() for x in numbers], pa.binary()), pa.array([float(within[x].sum()) for x in numbers], pa.float64())],
                    names=["doc_id", "tokens", "within"],
                )

    rows = saved(both.repartition(parts_of(spark), "block").sortWithinPartitions("block", "role").mapInArrow(run, "doc_id long, tokens binary, within double"), "encoded")
    released(blocks)
    return Corpus(rows, vocab, counts)


def _tokens(value: pa.Scalar) -> np.ndarray:
    b = value.as_buffer()
    return np.frombuffer(b, np.uint16).astype(np.int32) if b.size else np.zeros(0, np.int32)


def runs_of(tokens: np.ndarray) -> list[np.ndarray]:
    """All tokens of a document, or RUNS runs of RUN tokens spread evenly over all of it where it has more than that."""
    n = len(tokens)
    return [tokens] if n <= RUNS * RUN else [tokens[i * n // RUNS :][:RUN] for i in range(RUNS)]


def _sample(rows: DataFrame) -> list[np.ndarray]:
    """Runs of tokens of WARM_DOCS documents, first in order of a hash. Hashes alone are ranked; then those rows are read."""
    keyed = rows.filter(F.octet_length("tokens") > 0).select(F.xxhash64("doc_id", "tokens").alias("key"), "tokens")
    chosen = keyed.select("key").distinct().orderBy("key").limit(WARM_DOCS)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[x.astype(np.uint16).tobytes() for x in runs_of(_tokens(t))] for t in b.column(1)], pa.list_(pa.binary()))], names=["key", "runs"])

    got = keyed.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).mapInArrow(run, "key long, runs array<binary>").collect()
    return [np.frombuffer(x, np.uint16).astype(np.int32) for r in sorted(got, key=lambda r: r.key) for x in r.runs]


def train_on(corpus: Corpus) -> Network:
    """The network of an encoded corpus. Parameters are added up in a tree on executors, and their mean arrives once."""
    warm = Network.start(corpus.counts)
    warm.train(iter(_sample(corpus.rows)), 4)
    shared = corpus.rows.sparkSession.sparkContext.broadcast(warm)  # a fixed size

    def local(batches):
        net = shared.value.like(shared.value.flat())
        n = net.train(_tokens(t) for b in batches for t in b.column(0))
        if n:
            yield vector_rows(net.flat().astype(np.float64) * n, n)

    total, n = summed(corpus.rows.select("tokens"), len(warm.flat()), local)
    return warm if total is None else warm.like(total / n)


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[Vocabulary, Network]:
    """Vocabulary and network of a corpus."""
    corpus = encode(docs, None, text_col, id_col)
    return corpus.vocab, train_on(corpus)


def score_on(corpus: Corpus, net: Network, split: bool = True) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all tokens) and mean_log_likelihood (null without tokens). No shuffle.

    Without ``split`` a word of a hashed entry has the probability of its entry.
    """
    shared = corpus.rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored():
            lp = np.concatenate([[0.0], np.cumsum(shared.value.log_probs(*contexts(held)))])
            n = np.array([len(d) for d in held])
            end = np.cumsum(n)
            total = lp[end] - lp[end - n] + (np.array(within) if split else 0)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(total), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

        ids, held, within, size = [], [], [], 0
        for b in batches:
            for i, t, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids.append(i)
                held.append(_tokens(t))
                within.append(w)
                size += len(held[-1])
                if size >= 60_000 or len(ids) >= 5000:
                    yield scored()
                    ids, held, within, size = [], [], [], 0
        if ids:
            yield scored()

    return corpus.rows.select("doc_id", "tokens", "within").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def score(docs: DataFrame, vocab: Vocabulary, net: Network, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Scores in which a word of a hashed entry counts as its entry."""
    return score_on(encode(docs, vocab, text_col, id_col), net, False)


def score_all(docs: DataFrame, vocab: Vocabulary, net: Network, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Scores in which the probability of a hashed entry is split among its words by their counts in the training texts."""
    return score_on(encode(docs, vocab, text_col, id_col), net)
