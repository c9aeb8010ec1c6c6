"""Benchmark decontamination by the q-gram lemma over overlapping diagonal bands, verified by banded alignment.

An item of length m within e edits of a text region shares at least m - q + 1 - q e of its q-grams with it, on diagonals
that span at most e. Hits are counted in diagonal bands of width 2 (e + 1) that overlap by half, so one band holds all
diagonals of any such region. Bands that reach the bound are aligned: semi-global edit distance within the band.

Letters are compared in lower case and all white space is one blank, code point by code point, so spans are code points
of the original text. Null or empty texts and items match nothing; items shorter than q must occur exactly. Of an item's
regions the one with fewest edits counts first, then the one further left; each further one lies clear of those before, until
none is left. Null ids and repeated items and documents are reported each; other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: q, edits allowed per item character, and the items that one broadcast block may hold (its size bound).
Q, RATE = 12, 0.06
BLOCK_CHARS, BLOCK_ITEMS = 8_000_000, 50_000
_BITS = 22
#: Code points below which letters have case (Adlam is the last such script), and q-gram hits held at once.
_CASED, HELD = 0x1EA00, 2_000_000


def _fold_table() -> np.ndarray:
    t = np.arange(_CASED, dtype=np.uint32)
    for i in range(_CASED):
        c = chr(i)
        low = c.lower()
        t[i] = 32 if c.isspace() else ord(low) if len(low) == 1 else i
    return t


_FOLD: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _FOLD[0]
    small = a < len(table)
    return table[a] if small.all() else np.where(small, table[np.where(small, a, 0)], a)


_B = np.uint64(0x9E3779B97F4A7C15)


def grams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of every q-gram (q = 12: by doubling, 3 steps and one addition)."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers, h, width = {1: _B}, {1: a.astype(np.uint64) + np.uint64(1)}, 1
        while width * 2 <= q:
            h[2 * width] = h[width][:-width] * powers[width] + h[width][width:]
            powers[2 * width] = powers[width] * powers[width]
            width *= 2
        out, done = h[width][:n], width
        for w in sorted(h, reverse=True):
            if w <= q - done:
                out = out * powers[w] + h[w][done : done + n]
                done += w
        out = out ^ (out >> np.uint64(29))
        return out * np.uint64(0xBF58476D1CE4E5B9)


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for an item of m characters: the rate, less where the lemma's bound would fall under 1."""
    return max(0, min(int(rate * m), (m - q) // q))


class Items:
    """One bounded block of items with its q-gram postings."""

    def __init__(self, rows: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.q, self.ids = q, [i for i, _ in rows]
        self.code = [codes(t) for _, t in rows]
        self.m = np.array([len(c) for c in self.code], np.int64)
        self.e = np.array([budget(int(m), q, rate) for m in self.m], np.int64)
        self.need = np.maximum(self.m - q + 1 - q * self.e, 1)
        self.short = [k for k, m in enumerate(self.m) if 0 < m < q]
        h = [grams(c, q) for c in self.code]
        keys = np.concatenate(h) if h else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        off = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, first, self.n = np.unique(keys[order], return_index=True, return_counts=True)
        self.first, self.item, self.off = first, item[order].astype(np.int64), off[order].astype(np.int64)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text position, item, item offset) of every shared q-gram, in portions of about HELD."""
        g = grams(a, self.q)
        at = np.flatnonzero(self.bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)]) if len(g) and len(self.keys) else np.zeros(0, np.int64)
        if not len(at):
            return
        k = np.searchsorted(self.keys, g[at])
        k[k == len(self.keys)] = 0
        fine = self.keys[k] == g[at]
        at, k = at[fine], k[fine]
        portion = np.cumsum(self.n[k]) // HELD
        for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(portion)) + 1):
            n = self.n[k[cut]]
            row = np.repeat(self.first[k[cut]] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
            yield np.repeat(at[cut], n), self.item[row], self.off[row]

    def candidates(self, a: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of the bands that reach the lemma's bound, neighbours merged."""
        u, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p, item, off in self.hits(a):
            band = np.floor_divide(p - off, self.e[item] + 1)
            # Each diagonal lies in band b (from b * half) and in b - 1: bands are 2 * half wide and overlap by half.
            key, times = np.unique(np.concatenate([item, item]) * (1 << 40) + np.concatenate([band, band - 1]) + (1 << 30), return_counts=True)
            u, back = np.unique(np.concatenate([u, key]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, times]), len(u)).astype(np.int64)
        out: list[tuple[int, int, int]] = []
        for k in u[n >= self.need[u >> 40]]:
            i = int(k >> 40)
            lo = (int(k & ((1 << 40) - 1)) - (1 << 30)) * int(self.e[i] + 1)
            hi = lo + 2 * int(self.e[i] + 1) - 1
            if out and out[-1][0] == i and lo <= out[-1][2] + 1 and hi - out[-1][1] <= 8 * int(self.e[i] + 1):
                out[-1] = (i, out[-1][1], hi)
            else:
                out.append((i, lo, hi))
        return out

    def regions(self, i: int, a: np.ndarray, bands: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(edits, start, end) of item ``i``: the best region of all bands, then the best of what lies clear of it, and so on."""
        heap: list[tuple] = []
        taken: list[tuple[int, int]] = []

        def look(lo, hi, x, y):
            """The best region of a band within text x .. y, if any, waits in the heap."""
            if y - x >= self.m[i] - self.e[i] and (r := align(self.code[i], a[x:y], lo - x, hi - x, int(self.e[i]))):
                heapq.heappush(heap, (r[0], r[1] + x, r[2] + x, lo, hi, x, y))

        for lo, hi in bands:
            look(lo, hi, 0, len(a))
        out = []
        while heap:
            e, s, t, lo, hi, x, y = heapq.heappop(heap)
            clash = next(((b, c) for b, c in taken if s < c and b < t), None)
            if clash is None:
                taken.append((s, t))
                out.append((e, s, t))
            cut = clash or (s, t)
            look(lo, hi, x, min(cut[0], y))
            look(lo, hi, max(cut[1], x), y)
        return out

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, end, edits) of every region of ``text`` within budget; regions of one item do not overlap."""
        a = codes(text or "")
        bands: dict[int, list[tuple[int, int]]] = {}
        for i, lo, hi in self.candidates(a):
            bands.setdefault(i, []).append((lo, hi))
        out = [(self.ids[i], s, t, e) for i, b in bands.items() for e, s, t in self.regions(i, a, b)]
        for i in self.short:
            c, end = self.code[i], 0
            for s in np.flatnonzero(np.all(np.lib.stride_tricks.sliding_window_view(a, len(c)) == c, axis=1)).tolist() if len(a) >= len(c) else []:
                if s >= end:
                    end = s + len(c)
                    out.append((self.ids[i], s, end, 0))
        return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def align(item: np.ndarray, text: np.ndarray, lo: int, hi: int, e: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``item`` in ``text`` on diagonals lo - e .. hi + e, if within e edits."""
    m, n = len(item), len(text)
    lo, hi = max(lo, -e), min(hi, n - m + e)  # others hold no region
    if lo > hi:
        return None
    for d in range(max(lo, 0), min(hi, n - m) + 1):  # a verbatim copy needs no table
        if item[0] == text[d] and np.array_equal(item, text[d : d + m]):
            return 0, d, d + m
    if e == 0:
        return None
    lo, hi = lo - e, hi + e
    diag = np.arange(lo, hi + 1)
    big = 1 << 20
    # Column j of row i stands for the text position i + diag[j]; row 0 may start anywhere.
    cost = np.where((diag >= 0) & (diag <= n), 0, big)
    start = diag.copy()
    step = np.arange(len(diag))
    for i in range(1, m + 1):
        t = i + diag
        ok = (t >= 0) & (t <= n)
        ch = text[np.clip(t - 1, 0, n - 1)]
        sub = cost + np.where((t >= 1) & (ch == item[i - 1]), 0, 1) + np.where(t >= 1, 0, big)
        dele = np.append(cost[1:], big) + 1  # an item character without a partner
        new, src = np.where(dele < sub, dele, sub), np.where(dele < sub, np.append(start[1:], 0), start)
        new = np.where(ok, new, big)
        run = np.minimum.accumulate(new - step) + step  # text characters without a partner
        from_ = np.maximum.accumulate(np.where(new - step <= np.minimum.accumulate(new - step), step, 0))
        cost, start = np.where(ok, run, big), src[from_]
    best = int(cost.min())
    if best > e:
        return None
    j = int(np.flatnonzero(cost == best)[0])
    return best, int(start[j]), int(m + diag[j])


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in blocks of bounded size: usually one; a larger benchmark takes one pass of the documents a block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


MATCH = "doc_id long, item_id long, start long, end long, edits long"


def contaminations(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """One row per region of a document that is within the edit budget of an item. No shuffle; clean documents give no row."""
    out = None
    for rows in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            items = Items(shared.value, q, rate)
            for b in batches:
                got = [(d.as_py(), *m) for d, t in zip(b.column(0), b.column(1), strict=True) for m in items.matches(t.as_py())]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """Rows of ``docs`` whose text holds no item; every column is kept. Rows are judged where they lie, so nothing moves."""
    at = docs.columns.index("text")
    for rows in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            items = Items(shared.value, q, rate)
            for b in batches:
                yield b.filter(pa.array([not items.matches(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
