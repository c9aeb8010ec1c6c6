"""Approximate nearest neighbours: anisotropic product quantisation, four-bit table scans, exact reranking.

Smallest Euclidean distance is a maximum inner product: a vector x becomes (x, -|x|^2 / 2) and a query q becomes (q, 1).
Codebooks of 16 words per subspace are trained on a bounded sample with a score-aware loss, where the residual parallel to
the vector weighs ``eta`` times the orthogonal one; every vector is coded with that loss by coordinate descent. Two codes
share a byte. Scans add 16-entry table look-ups, keep the best candidates of a block, and rescore them on the original
vectors in double precision. A code's error in a subspace is at most the length of its residual times that of the query
there, so every other vector whose score may hide a better one by this bound is rescored too. Equal vectors have equal codes,
so ties are broken by id from the scan on.

Every vector is dealt to the nearest of up to 512 centroids, one for each BLOCK vectors, and a query visits as many of them as
it takes to hold 0.98 of the true neighbours within the sample. A crowded partition is cut into data blocks, and its queries
into query blocks; each pair of blocks meets in one task of bounded size. A table of up to BLOCK vectors is one partition, so
there the result is exact.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of
different lengths are not compared. Rows that share an id are one point of several places: its distance is the smallest.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Vectors the codebooks are trained on at most; components per subspace; parallel weight; rows of a data and query block.
FIT_ROWS, SUB, ETA = 8192, 2, 4.0
BLOCK, QUERY_BLOCK = 16_384, 16_384
#: Centroids at most, and the share of true neighbours of the sample that visited partitions must hold.
PARTITIONS, HELD = 512, 0.98
K, RERANK = 10, 200


class Codebooks:
    def __init__(self, words: np.ndarray, scale: np.ndarray, mean: np.ndarray, eta: float):
        self.words, self.scale, self.mean, self.eta = words, scale, mean, eta  # words: (subspaces, 16, SUB)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors with the norm component, scaled and padded to whole subspaces."""
        x = x - self.mean
        y = np.concatenate([x, -0.5 * (x * x).sum(1, keepdims=True)], 1) / self.scale
        return np.pad(y, ((0, 0), (0, self.words.shape[0] * SUB - y.shape[1]))).astype(np.float32)

    def code(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, subspaces): nearest words, then coordinate descent on the anisotropic loss."""
        y = self.lift(x)
        s = self.words.shape[0]
        y3 = y.reshape(len(y), s, SUB)
        err = ((y3[:, :, None, :] - self.words[None]) ** 2).sum(3)
        codes = err.argmin(2)
        unit = y3 / np.maximum(np.linalg.norm(y, axis=1), 1e-12)[:, None, None]
        par = np.einsum("nsd,skd->nsk", unit, self.words)  # parallel part of each word
        own = (unit * y3).sum(2)
        rows = np.arange(len(y))[:, None]
        residual = (own - np.take_along_axis(par, codes[:, :, None], 2)[:, :, 0]).sum(1)
        for _ in range(rounds):
            for j in range(s):
                rest = residual - (own[:, j] - par[rows[:, 0], j, codes[:, j]])
                loss = err[:, j] + (self.eta - 1) * (rest[:, None] + own[:, j : j + 1] - par[:, j]) ** 2
                new = loss.argmin(1)
                residual = rest + own[:, j] - par[rows[:, 0], j, new]
                codes[:, j] = new
        return codes.astype(np.uint8)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Lifted queries (queries, subspaces, SUB)."""
        q = np.concatenate([q - self.mean, np.ones((len(q), 1))], 1) * self.scale
        s = self.words.shape[0]
        return np.pad(q, ((0, 0), (0, s * SUB - q.shape[1]))).reshape(len(q), s, SUB)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Look-up tables (queries, subspaces, 16) of inner products with the lifted query."""
        return np.einsum("qsd,skd->qsk", self.asked(q), self.words).astype(np.float32)

    def lost(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of the residuals (n, subspaces), with room for single-precision rounding."""
        y = self.lift(x).reshape(len(x), -1, SUB)
        word = self.words[np.arange(y.shape[1]), codes]
        length = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(2))
        return (length(y - word) + 1e-5 * (length(y) + length(word))).astype(np.float32)


def fit(x: np.ndarray, eta: float = ETA, rounds: int = 8, seed: int = 1) -> Codebooks:
    """Train by alternating score-aware assignment and weighted means per word."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    c = x - mean
    lifted = np.concatenate([c, -0.5 * (c * c).sum(1, keepdims=True)], 1)
    scale = np.ones(lifted.shape[1])
    scale[-1] = max(lifted[:, -1].std() / max(lifted[:, :-1].std(), 1e-12), 1e-12)  # the norm component in the others' range
    s = -(-lifted.shape[1] // SUB)
    books = Codebooks(np.zeros((s, 16, SUB), np.float32), scale, mean, eta)
    y = books.lift(x).reshape(len(x), s, SUB)
    pick = rng.choice(len(x), 16, replace=len(x) < 16)
    books.words = y[pick].transpose(1, 0, 2).copy() + rng.normal(0, 1e-4, (s, 16, SUB)).astype(np.float32)
    unit = y / np.maximum(np.linalg.norm(y.reshape(len(x), -1), axis=1), 1e-12)[:, None, None]
    for _ in range(rounds):
        codes = books.code(x)
        lost = (unit * (y - books.words[np.arange(s), codes])).sum(2)  # parallel error by subspace
        total = lost.sum(1)
        for j in range(s):
            rest = total - lost[:, j]  # of the other subspaces
            for k in range(16):
                m = codes[:, j] == k
                if not m.any():
                    continue
                # Zero of the gradient: (sum I + (eta - 1) u u^T) w = sum y + (eta - 1) u (u . y + rest).
                u, v = unit[m, j], y[m, j]
                a = m.sum() * np.eye(SUB) + (eta - 1) * u.T @ u
                b = v.sum(0) + (eta - 1) * (((u * v).sum(1) + rest[m])[:, None] * u).sum(0)
                books.words[j, k] = np.linalg.solve(a, b)
            new = (unit[:, j] * (y[:, j] - books.words[j, codes[:, j]])).sum(1)
            total += new - lost[:, j]
            lost[:, j] = new
    return books


class Index:
    """Codebooks, centroids, and how many of the nearest centroids' partitions a query visits."""

    def __init__(self, sample: np.ndarray, total: int, k: int, seed: int = 1):
        self.books = fit(sample)
        rng = np.random.default_rng(seed)
        n = min(PARTITIONS, -(-total // BLOCK), max(1, len(sample) // 16))
        self.centroids = sample[rng.choice(len(sample), n, replace=False)]
        for _ in range(10 if n > 1 else 0):
            near = self.nearest(sample, 1)[:, 0]
            times = np.bincount(near, minlength=n)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, sample)
            self.centroids[times > 0] = sums[times > 0] / times[times > 0, None]
        self.probes = n if n == 1 else self._probes(sample, k, rng)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the ``n`` nearest centroids, in order."""
        d = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(d, 1, kind="stable")[:, :n]

    def _probes(self, sample, k, rng) -> int:
        asked = rng.choice(len(sample), min(512, len(sample)), replace=False)
        d = (sample**2).sum(1) - 2 * sample[asked] @ sample.T
        d[np.arange(len(asked)), asked] = np.inf
        true = np.argsort(d, 1, kind="stable")[:, :k]
        order = self.nearest(sample[asked], len(self.centroids))
        rank = np.argsort(order, 1)  # place of each partition in a query's order
        at = np.take_along_axis(rank, self.nearest(sample, 1)[:, 0][true], 1)
        return int(np.searchsorted(np.cumsum(np.bincount(at.ravel(), minlength=len(self.centroids))) / at.size, HELD) + 1)


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    v = F.col("embedding")
    good = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(good & F.col("vec_id").isNotNull())
    return out if dim is None else out.filter(F.size("embedding") == dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, rerank: int = RERANK, fit_rows: int = FIT_ROWS, self_match: bool = False) -> DataFrame:
    """Each query's k nearest of ``vectors``: (query_id, rank, vec_id, score), ties to the smaller id."""
    found = None
    for r in usable(vectors).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect():
        part = _found(usable(vectors, r.d), usable(queries, r.d), r.n, k, rerank, fit_rows, self_match)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")


def _found(data: DataFrame, asked: DataFrame, total: int, k: int, rerank: int, fit_rows: int, self_match: bool) -> DataFrame:
    """The k best of every pair of a data and a query block: (query_id, vec_id, score)."""
    spark = data.sparkSession
    # Hashes alone are ranked; then the rows of those chosen are read.
    keyed = data.withColumn("key", F.xxhash64("vec_id", "embedding"))
    chosen = keyed.select("key").distinct().orderBy("key").limit(fit_rows)
    rows = keyed.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).select("key", "embedding").collect()
    sample = np.array([r.embedding for r in sorted(rows, key=lambda r: r.key)])
    index = Index(sample, total, k)
    shared = spark.sparkContext.broadcast(index)  # a few hundred KB

    def dealt(frame: DataFrame, visits: int) -> DataFrame:
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    near = shared.value.nearest(np.stack(pdf["embedding"].to_numpy()), visits)
                    yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), visits), "embedding": pdf["embedding"].repeat(visits).to_numpy(), "p": near.ravel().astype(np.int32)})

        return saved(frame.mapInPandas(run, "vec_id long, embedding array<double>, p int"), "dealt")

    d, q = dealt(data, 1), dealt(asked, index.probes)
    blocks = lambda f, size, name: f.groupBy("p").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    cuts = F.broadcast(blocks(d, BLOCK, "data_blocks").join(blocks(q, QUERY_BLOCK, "query_blocks"), "p"))  # PARTITIONS rows at most
    own = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    d = d.join(cuts, "p").withColumn("b", own(0, "data_blocks")).withColumn("qb", every("query_blocks"))
    q = q.join(cuts, "p").withColumn("qb", own(1, "query_blocks")).withColumn("b", every("data_blocks"))

    def scan(key, left, right):
        return _scan(shared.value.books, left, right, k, rerank, self_match)

    keys, columns = ["p", "b", "qb"], ["vec_id", "embedding"]
    return d.select(*keys, *columns).groupBy(*keys).cogroup(q.select(*keys, *columns).groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")


def _scan(books, data: pd.DataFrame, asked: pd.DataFrame, k: int, rerank: int, self_match: bool) -> pd.DataFrame:
    if not len(data) or not len(asked):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    data = data.sort_values("vec_id", kind="stable")
    ids, x = data["vec_id"].to_numpy(np.int64), np.ascontiguousarray(np.stack(data["embedding"].to_numpy()))
    k_rows = k
    if len(again := np.unique(ids)) < len(ids):  # equal rows once; then so many more rows may be needed for k ids
        rows = np.column_stack([ids.view(np.uint64), x.view(np.uint64)])
        keep = np.sort(np.unique(rows.view(f"V{8 * rows.shape[1]}").ravel(), return_index=True)[1])
        ids, x = ids[keep], x[keep]
        k_rows += len(ids) - len(again)
    codes = np.concatenate([books.code(x[i : i + 4096]) for i in range(0, len(x), 4096)])
    lost = np.concatenate([books.lost(x[i : i + 4096], codes[i : i + 4096]) for i in range(0, len(x), 4096)]).T
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    packed = (codes[:, ::2] | codes[:, 1::2] << 4).T.copy()  # two four-bit codes a byte
    qid, q = asked["vec_id"].to_numpy(np.int64), np.stack(asked["embedding"].to_numpy())
    out = []
    for at in range(0, len(q), 64):
        tables = books.tables(q[at : at + 64])
        slack = np.linalg.norm(books.asked(q[at : at + 64]), axis=2).astype(np.float32) @ lost
        far = ((q[at : at + 64] - books.mean) ** 2).sum(1)
        if tables.shape[1] % 2:
            tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
        pairs = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(tables), -1, 256)
        for r in range(len(tables)):
            score = pairs[r, 0][packed[0]]
            for j in range(1, len(packed)):
                score += pairs[r, j][packed[j]]
            if not self_match:
                score = np.where(ids == qid[at + r], -np.inf, score)
            top = min(rerank, len(score))
            # Everything above the cut, then the smallest ids on it: ids are ascending here.
            cut = np.partition(score, len(score) - top)[len(score) - top]
            above = np.flatnonzero(score > cut)
            pick = np.concatenate([above, np.flatnonzero(score == cut)[: top - len(above)]])
            pick = pick[np.isfinite(score[pick])]
            dist = np.sqrt(((x[pick] - q[at + r]) ** 2).sum(1))
            # An inner product is (far - distance^2) / 2; whatever may reach that of the k-th best is rescored as well.
            least = (far[r] - np.partition(dist, k_rows - 1)[k_rows - 1] ** 2) / 2 if len(dist) >= k_rows else -np.inf
            may = score + slack[r] * (1 + 1e-5) >= least - 1e-9 * far[r]
            may &= np.isfinite(score)
            may[pick] = False
            more = np.flatnonzero(may)
            pick, dist = np.concatenate([pick, more]), np.concatenate([dist, np.sqrt(((x[more] - q[at + r]) ** 2).sum(1))])
            order = np.lexsort((ids[pick], dist))
            order = order[np.sort(np.unique(ids[pick][order], return_index=True)[1])[:k]]
            out.append(pd.DataFrame({"query_id": qid[at + r], "vec_id": ids[pick][order], "score": dist[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
