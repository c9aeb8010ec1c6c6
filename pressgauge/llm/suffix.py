"""Removal of byte strings of 200 that start anywhere else, by suffix arrays over the texts around shared anchors.

Every 200-byte window owns an anchor: the 32-byte string in it with the smallest hash, the leftmost on ties. Equal windows
own equal anchors at the same offset, so equal windows meet under their anchor's hash wherever they lie. Windows with one
anchor form a context (the bytes they cover together). Contexts that occur twice as they are get counted by their hash,
within tasks first, since a third of all rows may be copies of one text. Different contexts under one anchor are read as
strings of eight-byte symbols that start at the anchor, and linear grouping construction sorts the suffixes of a block of
such strings, without recursive renaming: groups of suffixes with one Lyndon prefix are processed in descending order
through previous-smaller pointers, then each group's order is emitted. A window holds 24 whole symbols; suffixes next to
each other in that order with 24 symbols in common, and the same eight bytes around them, are equal windows, byte by byte.

Windows never cross texts. Null text is empty; texts under 200 bytes lose nothing; repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, hot_keys, released, saved, small_batches
from .minhash import _batches
from .shingles import mix, powers, prefix_hash

WINDOW, GRAM = 200, 32
#: Bytes of a symbol, and whole symbols that every window holds from its first symbol's start.
SYMBOL = 8
CORE = WINDOW // SYMBOL - 1
_LOW = np.uint64(0xFFFFFF)
#: Contexts counted together (half as many have their suffixes sorted together), and occurrences combined before they are sent.
BLOCK, COMBINE = 10_000, 150_000
#: Contexts of one anchor that meet in one place; those of crowded anchors are dealt in groups of about so many.
CROWD = 1_000
#: Characters a worker hashes at once, a few dozen bytes of arrays each.
CHARS = 250_000


def gsaca(t: list[int]) -> list[int]:
    """Suffix array of ``t``, whose last symbol must be the only smallest one."""
    n = len(t)
    sa = sorted(range(n), key=t.__getitem__)
    group, size, place, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for i, s in enumerate(sa):
        if t[s] != t[sa[start]]:
            start = i
        group[s], place[s] = start, i
        size[start] += 1
    high = n
    while high:
        low = group[sa[high - 1]]
        count: dict[int, int] = {}
        for s in sorted(sa[low:high]):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        by: dict[int, list[int]] = {}
        for p, k in count.items():
            by.setdefault(k, []).append(p)
        # More repeats of this group's prefix sort higher: they leave their group for its end first.
        for k in sorted(by, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by[k]:
                moved.setdefault(group[p], []).append(p)
            for g, ps in moved.items():
                end = g + size[g]
                if len(ps) == size[g]:
                    continue  # the whole group moves: it stays where it is
                for p in ps:
                    end -= 1
                    at, other = place[p], sa[end]
                    sa[at], sa[end], place[other], place[p] = other, p, at, end
                size[g] -= len(ps)
                size[end] = len(ps)
                for p in ps:
                    group[p] = end
        high = low
    out, free, done = [0] * n, list(range(n)), bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = prev[s]
    return out


def anchors(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first and last window start, anchor place, anchor hash, context hash) of every context, places within the text."""
    b = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    end = np.cumsum(size)
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(b) < WINDOW:
        return empty
    with np.errstate(over="ignore"):
        p, inv = prefix_hash(b), powers(len(b))[1]
        m = len(b) - GRAM + 1
        h = mix((p[GRAM:] - p[:-GRAM]) * inv[:m])
        x = (h & ~_LOW) | (np.arange(m, dtype=np.uint64) & _LOW)
        width, span = 1, WINDOW - GRAM + 1
        while width * 2 <= span:
            x = np.minimum(x[:-width], x[width:])
            width *= 2
        rest = span - width
        x = np.minimum(x[: len(x) - rest], x[rest:])
        # Windows that stay within one text.
        s = np.concatenate([np.arange(e - k, e - WINDOW + 1) for e, k in zip(end.tolist(), size.tolist(), strict=True) if k >= WINDOW] or [np.zeros(0, np.int64)])
        if not len(s):
            return empty
        at = s + (((x[s] & _LOW).astype(np.int64) - s) & int(_LOW))
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]))
        first, last = s[cut], s[np.append(cut[1:], len(s)) - 1]
        place = at[cut]
        stop = last + WINDOW
        c = mix((p[stop] - p[first]) * inv[first] + ((place - first) * 1_000_003 + (stop - first)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        doc = np.searchsorted(end, first, side="right")
        base = (end - size)[doc]
        return doc, first - base, last - base, place - base, h[place].view(np.int64), c.view(np.int64)


def equal_windows(body: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the body, offset) of every window that starts elsewhere in ``body`` too, symbols starting at ``at``, by number and offset."""
    raw = np.frombuffer(b"".join(body), np.uint8)
    size = np.array([len(x) for x in body], np.int64)
    base = np.cumsum(size) - size
    lead = at.astype(np.int64) % SYMBOL
    k = (size - lead) // SYMBOL
    # Symbols of all bodies, one slot of 0 after each body's own.
    own = np.repeat(np.arange(len(body)), k + 1)
    slot = np.arange(len(own)) - np.repeat(np.cumsum(k + 1) - (k + 1), k + 1)
    b = lead[own] + slot * SYMBOL
    real = slot < k[own]
    value = np.zeros(len(own), np.uint64)
    value[real] = raw[(base[own] + b)[real][:, None] + np.arange(SYMBOL)].view(np.uint64)[:, 0]
    t = np.ones(len(own) + 1, np.int64)
    t[:-1][real] = 2 + np.unique(value[real], return_inverse=True)[1]
    t[-1] = 0
    order = np.array(gsaca(t.tolist()))[1:]
    order = order[slot[order] + CORE <= k[own[order]]]
    one, two = order[:-1], order[1:]
    alike = np.arange(len(one))  # neighbours with a common prefix of so many symbols
    for i in range(CORE):
        alike = alike[t[one[alike] + i] == t[two[alike] + i]]
    same = np.zeros(len(order) + 1, bool)
    same[alike + 1] = True
    repeat = same[:-1] | same[1:]
    group, order = np.cumsum(~same[:-1])[repeat], order[repeat]
    # The windows around each such run of symbols: r bytes before it and the rest after it.
    r = np.arange(SYMBOL)
    s = (b[order][:, None] - r).ravel()
    o, g, r = np.repeat(own[order], SYMBOL), np.repeat(group, SYMBOL), np.tile(r, len(order))
    fits = (s >= 0) & (s + WINDOW <= size[o])
    s, o, g, r = s[fits], o[fits], g[fits], r[fits]
    q = np.arange(SYMBOL)
    around = raw[(base[o] + s)[:, None] + np.where(q < r[:, None], q, q + CORE * SYMBOL)].view(np.uint64)[:, 0]
    rank = np.lexsort((around, r, g))
    eq = (g[rank][1:] == g[rank][:-1]) & (r[rank][1:] == r[rank][:-1]) & (around[rank][1:] == around[rank][:-1])
    hit = np.zeros(len(s), bool)
    hit[rank[1:][eq]] = True
    hit[rank[:-1][eq]] = True
    s, o = s[hit], o[hit]
    rank = np.lexsort((s, o))
    return o[rank], s[rank]


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), t.alias("text"))


_ROW = "h long, c long, n long, k1 long, k2 long, first int, last int, place int"
_ARROW = pa.schema([(a, pa.int32() if k == "int" else pa.int64()) for a, k in (x.split() for x in _ROW.split(", "))])


def _raw(texts):
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def contexts(docs: DataFrame, text_col: str) -> DataFrame:
    """Contexts (h, c), how often each occurs, and one place of each; combined within a task before anything is sent."""

    def flush(held):
        cols = [np.concatenate([x[i] for x in held]) for i in range(8)]
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        new = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]))
        n = np.add.reduceat(cols[2], new)
        cols = [c[new] for c in cols]
        cols[2] = n
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    def run(batches):
        held, n = [], 0
        for b, texts in _batches(batches, 2, CHARS):
            doc, first, last, place, h, c = anchors(_raw(texts))
            if len(doc):
                k1, k2 = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
                held.append((h, c, np.ones(len(h), np.int64), k1, k2, first, last, place))
                n += len(h)
            if n >= COMBINE:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return _keyed(docs, text_col).mapInArrow(run, _ROW)


_FOUND = "h long, c long, whole boolean, m long, k1 long, k2 long, first int, last int, place int"


def _counted(rows: list[np.ndarray]) -> list[np.ndarray] | None:
    """Repeated anchors of a block of rows sorted by (h, c): (h, c, whole, m, k1, k2, first, last, place), ``m`` contexts an anchor."""
    h, c, n = rows[:3]
    # Combined rows of one context from several tasks are one context.
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
    n = np.add.reduceat(n, new)
    h, c, *rest = (rows[i][new] for i in (0, 1, 3, 4, 5, 6, 7))
    run = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    m = np.diff(np.append(run, len(h)))
    keep, m = np.repeat(np.add.reduceat(n, run) > 1, m), np.repeat(m, m)
    return [x[keep] for x in (h, c, n > 1, m, *rest)] if keep.any() else None


def repeated(docs: DataFrame, text_col: str) -> DataFrame:
    """Contexts under anchors that occur more than once; ``whole`` where the context itself does, ``m`` contexts under its anchor."""
    rows = contexts(docs, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "h").sortWithinPartitions("h", "c")
    schema = pa.schema([(a, {"boolean": pa.bool_(), "int": pa.int32()}.get(k, pa.int64())) for a, k in (x.split() for x in _FOUND.split(", "))])

    def blocks(batches) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        n = 0
        for b in batches:
            held.append([b.column(i).to_numpy() for i in range(8)])
            n += b.num_rows
            if n >= BLOCK and held[0][0][0] != held[-1][0][-1]:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last anchor may go on
                if cut:
                    yield [c[:cut] for c in cols]
                held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches):
        for cols in blocks(batches):
            if len(cols[0]) and (got := _counted(cols)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, _FOUND)


def once_a_task(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, text) of texts of at least a window, copies left out as far as the task's last million texts tell."""

    def run(batches):
        seen: set = set()
        for b in batches:
            keep = []
            for i, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    keep.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            if keep:
                yield b.take(pa.array(keep, pa.int64()))

    return _keyed(docs, text_col).filter(F.octet_length("text") >= WINDOW).mapInArrow(run, "k1 long, k2 long, text string")


_PART = "h long, c long, begin int, stop int, core long, left long, right long, holds int, asks int"
_PARTS = pa.schema([(a, pa.int32() if k == "int" else pa.int64()) for a, k in (x.split() for x in _PART.split(", "))])


def compared(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts (h, c, begin, stop) of contexts, from their first byte, that windows shared with another context of the anchor cover.

    A crowded anchor's contexts are dealt in groups. Windows that a group's suffix order does not settle meet the other groups
    by hash, eight to a row of their common symbols; a settled window stands once a block of groups, so a passage in most of
    the rows adds a row a block. Also returned: the written rows, for release.
    """
    groups = F.ceil(F.col("m") / CROWD)
    cut = found.filter("m > 1").join(texts, ["k1", "k2"]).select("h", "c", "whole", "first", "last", "place", "text", F.pmod("c", groups).cast("int").alias("salt"), (groups > 1).alias("crowd"))

    def slices(batches):
        for b in batches:
            first, last, place = (b.column(i).to_numpy() for i in (3, 4, 5))
            body, held, raw = [], None, b""
            for i, t in enumerate(b.column(6)):
                if (s := t.as_py()) is not held:
                    held, raw = s, s.encode("utf-8", "surrogatepass")
                body.append(raw[first[i] : last[i] + WINDOW])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 7, 1, 2, 8)), pa.array((place - first).astype(np.int32)), pa.array(body, pa.binary())], names=["h", "salt", "c", "whole", "crowd", "at", "body"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut.mapInArrow(slices, "h long, salt int, c long, whole boolean, crowd boolean, at int, body binary").repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "c")

    def shared(cols):
        h, _, c, whole, crowd, at, body = cols
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
        h, c, whole, crowd, at, body = h[new], c[new], whole[new], crowd[new], at[new], [body[i] for i in new]
        own, off = equal_windows(body, at)
        if crowd.any():
            yield from unsettled(h, c, whole, at, body, np.flatnonzero(crowd), own, off)
        keep = ~whole[own]  # whole contexts are covered as they are
        own, off = own[keep], off[keep]
        if len(own):
            lo = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)]))
            hi = np.append(lo[1:], len(own)) - 1
            o = own[lo]
            yield h[o], c[o], off[lo], off[hi] + WINDOW

    def unsettled(h, c, whole, at, body, few, own, off):
        """Rows of the contexts ``few``, one for each run of CORE symbols: its hash, the eight bytes before and after it, and two
        bit sets over the windows around it, those to be counted (not met in the block, or the first of those met alike) and
        those that ask whether they are met elsewhere."""
        size = np.array([len(body[i]) for i in few])
        pad = bytes(SYMBOL)
        raw = np.frombuffer(pad + pad.join(body[i] for i in few) + pad, np.uint8)
        lead = at[few] % SYMBOL
        n = np.maximum((size - lead) // SYMBOL - CORE + 1, 0)
        o = np.repeat(np.arange(len(few)), n)
        b = lead[o] + SYMBOL * (np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n))
        start = (np.cumsum(size + SYMBOL) - size)[o] + b
        with np.errstate(over="ignore"):
            p, inv = prefix_hash(raw), powers(len(raw))[1]
            core = mix(mix((p[start + CORE * SYMBOL] - p[start]) * inv[start]) + h[few][o].view(np.uint64))
        q = np.arange(SYMBOL)
        left = raw[(start - SYMBOL)[:, None] + q].view(np.uint64)[:, 0]
        right = raw[(start + CORE * SYMBOL)[:, None] + q].view(np.uint64)[:, 0]
        place = b[:, None] - q
        real = (place >= 0) & (place + WINDOW <= size[o][:, None])
        longest = max(map(len, body))
        met = real & np.isin(few[o][:, None] * longest + place, own * longest + off)
        i, r = np.nonzero(met)
        around = raw[(start[i] - r)[:, None] + np.where(q < r[:, None], q, q + CORE * SYMBOL)].view(np.uint64)[:, 0]
        rank = np.lexsort((around, r, core[i]))
        x, y, z = core[i][rank], r[rank], around[rank]
        first = rank[np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]))] if len(rank) else rank
        holds = real & ~met
        asks = (holds & ~whole[few][o][:, None]) @ (1 << q)
        holds[i[first], r[first]] = True
        holds = holds @ (1 << q)
        k = np.flatnonzero(holds)
        f = few[o][k]
        yield h[f], c[f], b[k], None, core[k].view(np.int64), left[k].view(np.int64), right[k].view(np.int64), holds[k], asks[k]

    def batch(h, c, *rest):
        cols = (h, c, *rest, *[None] * (len(_PARTS) - 2 - len(rest)))
        cols = [pa.nulls(len(h), f.type) if x is None else pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(cols, _PARTS, strict=True)]
        return pa.RecordBatch.from_arrays(cols, schema=_PARTS)

    def run(batches):
        held: list = []
        n = 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(7)])
            n += b.num_rows
            if n >= BLOCK // 2:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
                at = int(edge[-1]) + 1 if len(edge) else 0  # the last group may go on
                if at:
                    yield from (batch(*x) for x in shared([c[:at] for c in cols]))
                held, n = [[c[at:] for c in cols]], len(cols[0]) - at
        if held and n:
            yield from (batch(*x) for x in shared([np.concatenate(x) for x in zip(*held, strict=True)]))

    out = saved(rows.mapInArrow(run, _PART), "windows")
    part = ["h", "c", "begin", "stop"]
    return out.filter("core is null").select(part).unionByName(met_elsewhere(out.filter("core is not null"))), out


def met_elsewhere(cores: DataFrame) -> DataFrame:
    """Windows of crowded anchors' contexts (h, c, begin, stop) that other groups hold: runs of symbols that recur, then their windows."""
    again = cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    both = hot_join(cores, again, "core", hot_keys(cores, "core", cores.count()))
    r = F.explode(F.sequence(F.lit(0), F.lit(SYMBOL - 1))).alias("r")
    rows = both.select("h", "c", "begin", "core", "left", "right", "holds", "asks", r).filter("(shiftright(holds, r) & 1) = 1")
    w = F.expr(f"xxhash64(core, r, if(r = 0, 0L, shiftrightunsigned(left, {SYMBOL * 8} - 8 * r)), shiftleft(right, 8 * r))")
    rows = rows.select("h", "c", (F.col("begin") - F.col("r")).alias("begin"), F.expr("(shiftright(asks, r) & 1) = 1").alias("asks"), w.alias("w"))
    met = rows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    return rows.filter("asks").join(met, "w").select("h", "c", "begin", (F.col("begin") + WINDOW).alias("stop"))


def occurrences(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, c, k1, k2, first) of every context, each text once a task."""

    def run(batches):
        for b, texts in _batches(batches, 2, CHARS):
            doc, first, _, _, h, c = anchors(_raw(texts))
            k1, k2 = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, k1, k2)] + [pa.array(first.astype(np.int32))], names=["h", "c", "k1", "k2", "first"])

    return once_a_task(docs, text_col).mapInArrow(run, "h long, c long, k1 long, k2 long, first int")


def kept_parts(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, list[bytes]]:
    """(bytes removed, maximal removed runs, what is left) for spans in any order."""
    at = removed = runs = 0
    left = []
    for s, e in sorted(spans):
        if s > at or not runs:
            left.append(raw[at:s])
            runs += 1
            removed += e - s
            at = e
        elif e > at:
            removed += e - at
            at = e
    left.append(raw[at:])
    return removed, runs, left


def _removed(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, n_removed, n_spans, sha) of the texts that lose bytes, written."""
    found = saved(repeated(docs, text_col), "contexts")
    texts = once_a_task(docs, text_col)
    whole = found.filter("whole").select("h", "c", F.lit(0).alias("begin"), (F.col("last") - F.col("first") + WINDOW).cast("int").alias("stop"))
    parts, windows = compared(found, texts)
    covered = whole.unionByName(parts)
    spans = occurrences(docs, text_col).join(covered, ["h", "c"]).select("k1", "k2", (F.col("first") + F.col("begin")).alias("s"), (F.col("first") + F.col("stop")).alias("e"))
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def cut(batches):
        for b in batches:
            rows = []
            for text, spans_ in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                removed, runs, left = kept_parts(raw, [(x["s"], x["e"]) for x in spans_])
                rows.append((removed, runs, hashlib.sha256(b"".join(left)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["k1", "k2", "n_removed", "n_spans", "sha"])

    out = saved(texts.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(cut, "k1 long, k2 long, n_removed long, n_spans long, sha string").dropDuplicates(["k1", "k2"]), "cut")
    released(found, windows)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    with small_batches(docs.sparkSession):
        done = _removed(docs, text_col)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("all"))
    zero = F.lit(0).cast("long")
    return rows.join(done, ["k1", "k2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "all").alias("kept_sha256"))
