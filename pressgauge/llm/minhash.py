"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A document is its five-word shingles with weight tf x idf. Document frequencies cover all documents, in a hashed table of
fixed size. Consistent weighted samples agree with the probability of the weighted Jaccard similarity; bands of samples
propose pairs, and a pair counts when its exact weighted Jaccard similarity reaches the threshold. A class is a connected
component of such pairs; its id is the smallest doc_id in it.

Equal word sequences are one node from the start, so large groups of copies cost nothing. A bucket links its members to one
leader, not to each other. Members that stay apart from the leader's component meet eight leaders of it in the next
round. These rounds only merge most of a class cheaply: afterwards every pair of a bucket that is still in two components
is verified, in blocks inside tasks where the bucket is crowded.
Texts without a word (null, empty, marks only) are classes of their own. Repeated rows are copies of each other; null ids
stay, with the class of their text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import components
from .common import hot_join, hot_keys, lean, parts_of, released, saved, small_batches, summed, vector_rows
from .shingles import identity, mix, shingles, words

THRESHOLD = 0.8
#: At similarity 0.8 a pair shares at least one of 12 bands of 3 samples with probability 0.9998.
BANDS, ROWS = 12, 3
#: Entries of the document-frequency table (its size bound) and members a task verifies against one leader.
TABLE_BITS, GROUP = 20, 256
#: Leaders of a bucket in each round of links.
ROUNDS = (1, 8)
#: Members up to which a bucket's remaining pairs are rows; a larger bucket is compared in blocks of GROUP by GROUP.
FEW = 32


def _batches(batches: Iterator[pa.RecordBatch], at: int, chars: int = 1_000_000):
    """Slices of record batches of about ``chars`` characters, with their texts."""
    for b in batches:
        texts, i, n = b.column(at).to_pylist(), 0, 0
        for j, t in enumerate(texts):
            n += len(t or "")
            if n >= chars:
                yield b.slice(i, j + 1 - i), texts[i : j + 1]
                i, n = j + 1, 0
        if i < len(texts):
            yield b.slice(i), texts[i:]


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents per table entry, documents); every task's table is added up in a tree on the executors."""
    size = 1 << TABLE_BITS

    def count(batches):
        table, n = np.zeros(size, np.int64), 0
        for b, texts in _batches(batches, 0):
            doc, h = words(texts)
            _, s, _ = shingles(len(texts), doc, h)
            table += np.bincount((s >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=size)
            n += len(texts)
        if n:
            yield vector_rows(table, n)

    df, n = summed(docs.select(text_col), size, lean(count))
    return (np.zeros(size), 0) if df is None else (df, int(n))


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed idf in [1, 1.25]: copies in a large group share frequent shingles and must still resemble each other."""
    return (1 + np.log((n + 1) / (np.minimum(df, n) + 1)) / (4 * np.log(n + 2))).astype(np.float32)


def weights(idf: np.ndarray, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
    return idf[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] * tf.astype(np.float32)


def signatures(n_docs: int, d: np.ndarray, s: np.ndarray, w: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """(n_docs, samples) of improved consistent weighted sampling; rows without shingles are 0."""
    out = np.zeros((n_docs, samples), np.uint64)
    if not len(s):
        return out
    present, start = np.unique(d, return_index=True)
    group = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]]))
    lw = np.log(w)
    unit = np.float32(2.0**-24)
    low = np.uint64(0xFFFFFF)
    for k in range(samples):
        z = mix(s ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        y = mix(z + np.uint64(0xA0761D6478BD642F))
        f = lambda v, shift: (((v >> np.uint64(shift)) & low).astype(np.float32) + np.float32(0.5)) * unit
        r = -np.log(f(z, 40) * f(z, 16))
        c = -np.log(f(y, 40) * f(y, 16))
        beta = ((z & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        t = np.floor(lw / r + beta)
        a = np.log(c) - r * (t - beta) - r
        best = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == best[group])
        first = hit[np.concatenate([[True], group[hit[1:]] != group[hit[:-1]]])]
        out[present, k] = mix(s[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return out


def sketches(docs: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, node, bands): text_key is a hash of the text, node of the word sequence, null without words."""

    def run(batches):
        table = idf.value
        for b, texts in _batches(batches, 1):
            doc, h = words(texts)
            d, s, tf = shingles(len(texts), doc, h)
            sig = signatures(len(texts), d, s, weights(table, s, tf))
            bands = np.zeros((len(texts), BANDS), np.uint64)
            for k in range(BANDS):
                for j in range(ROWS):
                    bands[:, k] = mix(bands[:, k] * np.uint64(31) + sig[:, k * ROWS + j])
            node = identity(len(texts), doc, h)
            flat = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(node.view(np.int64), mask=node == 0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)],
                names=["doc_id", "text_key", "node", "bands"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), text_key(text_col)).mapInArrow(lean(run), "doc_id long, text_key long, node long, bands array<long>")


def text_key(text_col: str):
    return F.xxhash64(F.col(text_col).cast("string")).alias("text_key")


def node_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(node, text), each node at most once a task as far as its last million nodes tell."""

    def run(batches):
        seen: set[int] = set()
        for b, texts in _batches(batches, 0):
            node = identity(len(texts), *words(texts)).view(np.int64)
            keep = []
            for i, k in enumerate(node.tolist()):
                if k and k not in seen:
                    seen.add(k)
                    keep.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), b.column(0).take(pa.array(keep, pa.int64()))], names=["node", "text"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(lean(run), "node long, text string")


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    whole = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low
    return float(low / whole) if whole > 0 else 0.0


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, tf = shingles(1, *words([text]))
    return s, weights(idf, s, tf)


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs (a: leader, b) whose similarity reaches the threshold. A leader's members are dealt in groups of GROUP."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = salted.join(texts, salted["b"] == texts["node"]).select("a", "salt", F.lit(1).alias("role"), "b", "text")
    leaders = salts.join(texts, salts["a"] == texts["node"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    rows = leaders.unionByName(members)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role", "b")

    def run(batches):
        table, leader, key = idf.value, None, None
        for batch in batches:
            out = ([], [])
            for a, role, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if role == 0:
                    if key != a:
                        leader, key = vector(text, table), a
                elif jaccard(leader, vector(text, table)) >= threshold:
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


class _Block:
    """Stored members of a block. Postings of their shingles give a text's similarity to all of them at once."""

    def __init__(self):
        self.node, self.label, self.bands, self.texts, self.ready = [], [], [], [], False

    def close(self, idf: np.ndarray, root) -> None:
        self.label, self.bands, self.ready = np.array([root(c) for c in self.label]), np.array(self.bands), True
        self.idf, self.s = idf, None

    def vectors(self) -> None:
        self.own = [vector(t, self.idf) for t in self.texts]
        s, w = (np.concatenate([v[i] for v in self.own]) for i in (0, 1))
        d = np.repeat(np.arange(len(self.own)), [len(v[0]) for v in self.own])
        order = np.argsort(s, kind="stable")
        self.s, self.w, self.d, self.mass = s[order], w[order], d[order], np.bincount(d, w, len(self.own))

    def similar(self, s: np.ndarray, w: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.s, s, "left")
        n = np.searchsorted(self.s, s, "right") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        low = np.bincount(self.d[at], np.minimum(self.w[at], np.repeat(w, n)), len(self.mass))
        return low / (self.mass + w.sum(dtype=np.float64) - low)


def remaining(e: DataFrame, crowded: DataFrame, tried: DataFrame | None, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) among all pairs of nodes that share a bucket and are in two components; ``crowded`` are the hot buckets.

    A crowded bucket is dealt in groups, its largest component apart from the rest, and two groups meet in one block; two
    groups of the largest component never do. A pair is compared in the first band it shares, unless the task has already
    joined its components.
    """
    keys = ["band", "value"]
    e = e.drop("main")
    parts = e.groupBy(*keys, "component").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts"))
    parts = parts.filter("parts > 1").select(*keys, "n", F.col("m.component").alias("main"), *[F.ceil(c / GROUP).cast("int").alias(k) for k, c in (("rest_groups", F.col("n") - F.col("m.n")), ("main_groups", F.col("m.n")))])
    e = saved(hot_join(e, parts, keys, crowded), "apart")

    few = e.filter(F.col("n") <= FEW).select(*keys, "node", "component")
    one, two = few.select(*keys, F.col("node").alias("a"), F.col("component").alias("ca")), few.select(*keys, F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = one.join(two, keys).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()
    if tried is not None:
        pairs = pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = verified(saved(pairs, "pairs"), texts, idf, threshold)

    other = F.col("component") != F.col("main")
    group = F.pmod(F.xxhash64("node"), F.when(other, F.col("rest_groups")).otherwise(F.col("main_groups"))).cast("int")
    place = F.when(other, group).otherwise(F.col("rest_groups") + group)
    meets = F.sequence(F.lit(0), F.col("rest_groups") + F.when(other, F.col("main_groups")).otherwise(F.lit(0)) - 1)
    rows = e.filter(F.col("n") > FEW).select(*keys, "node", "component", "bands", place.alias("place"), F.explode(meets).alias("with"))
    rows = rows.select(*keys, F.least("place", "with").alias("x"), F.greatest("place", "with").alias("y"), (F.col("with") < F.col("place")).cast("int").alias("role"), "node", "component", "bands")
    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = [*keys, "x", "y"]
    rows = rows.join(texts, "node").select(*block, "role", "node", "component", "bands", "text").repartition(n, *block).sortWithinPartitions(*block, "role", "node")

    def run(batches):
        table, up, key, held = idf.value, {}, None, None

        def root(c):
            while c in up:
                c = up[c]
            return c

        def meet(node, component, bands, v, upto=None):
            """Links of one text with the stored ones, one for each component that it joins."""
            own = root(component)
            open_ = held.label != own
            if upto is not None:
                open_[upto:] = False
            if open_.any():
                open_ &= (held.bands == bands).argmax(1) == key[0]
            if not open_.any():
                return
            if held.s is None:
                held.vectors()
            hit = np.flatnonzero(open_ & (held.similar(*v()) >= threshold))
            for label, i in dict(zip(held.label[hit].tolist(), hit.tolist(), strict=True)).items():
                out[0].append(held.node[i])
                out[1].append(node)
                up[label] = own
                held.label[held.label == label] = own

        def end():
            """The pairs inside the group of a block that meets itself."""
            if held is not None and key[2] == key[3]:
                held.close(table, root)
                for i in range(1, len(held.node)):
                    meet(held.node[i], int(held.label[i]), held.bands[i], lambda i=i: held.own[i], i)

        out = ([], [])
        for batch in batches:
            for *at, role, node, component, bands, text in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if at != key:
                    end()
                    key, held = at, _Block()
                if role == 0:
                    held.node.append(node)
                    held.label.append(component)
                    held.bands.append(bands)
                    held.texts.append(text)
                elif held.node:
                    if not held.ready:
                        held.close(table, root)
                    meet(node, component, np.array(bands), lambda text=text: vector(text, table))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
            out = ([], [])
        end()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return links.unionByName(rows.mapInArrow(lean(run), "a long, b long"))


def members(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, first (doc_id and text_key of the class's first row), class_size."""
    with small_batches(docs.sparkSession):
        return _members(docs, threshold, id_col, text_col)


def _members(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``members``; every step in Python has been written when this returns."""
    df, n = frequencies(docs, text_col)
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(df, n))  # 4 MB
    keys = ["band", "value"]
    sk = saved(sketches(docs, idf, id_col, text_col), "sketches")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))
    nodes = saved(sk.filter("node is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.min(named).alias("first"), F.count("*").alias("n")), "nodes")
    entries = nodes.select("node", F.posexplode("bands").alias(*keys), "bands")
    # Nodes alone in their bucket are gone from here on.
    entries = saved(entries.join(entries.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), keys), "buckets")
    texts = saved(node_texts(docs, text_col).join(entries.select("node").distinct(), "node").groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = tried = found = None
    used = [entries, texts]

    def mixed():
        """Entries, with components, of the buckets that hold more than one; once whole, a bucket stays whole."""
        e = entries.withColumn("component", F.col("node")) if found is None else entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        e = saved(e, "labelled")
        main = e.groupBy(*keys).agg(F.min("component").alias("main"), F.max("component").alias("other"), F.count("*").alias("n")).filter(F.col("main") < F.col("other"))
        main = saved(main.select(*keys, "main", "n"), "main")
        crowded = saved(main.filter(F.col("n") >= F.lit(max(e.count() / 1000, 2))).select(*keys), "crowded")  # a thousand at most
        out = saved(hot_join(e, main.drop("n"), keys, crowded), "mixed")
        released(e, main)
        used.extend((out, crowded))
        return out, crowded

    def joined():
        out = saved(components(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))), links), "components")
        used.append(out)
        return out

    for leaders in ROUNDS:
        e, crowded = mixed()
        entries = e.drop("component", "main")
        # Leaders come from one component of the bucket, so a pair always joins two components.
        picks = [F.min(F.struct(F.xxhash64("node", F.lit(j)), F.col("node"))).alias(f"l{j}") for j in range(leaders)]
        lead = e.filter(F.col("component") == F.col("main")).groupBy(*keys).agg(*picks).select(*keys, F.array_distinct(F.array(*[f"l{j}.node" for j in range(leaders)])).alias("leads"))
        pairs = e.filter(F.col("component") != F.col("main"))
        pairs = hot_join(pairs, lead, keys, crowded).select(F.explode("leads").alias("a"), F.col("node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        used.append(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = saved(verified(pairs, texts, idf, threshold), "links")
        used.append(new)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            found = joined()
    rest = saved(remaining(*mixed(), tried, texts, idf, threshold), "links")
    used.append(rest)
    if not rest.isEmpty():
        links = rest if links is None else links.unionByName(rest)
        found = joined()
    comp = nodes.select("node", "first", "n").withColumn("component", F.col("node"))
    if found is not None:
        comp = comp.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    comp = saved(comp, "labels")
    best = comp.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    of_node = saved(hot_join(comp.select("node", "component"), best, "component", hot_keys(comp, "component", n)).drop("component"), "classes")
    hot = saved(nodes.filter(F.col("n") >= max(n / 1000, 2)).select("node"), "hot")
    released(*used)
    out = hot_join(sk.filter("node is not null").select("doc_id", "text_key", "node"), of_node, "node", hot).drop("node")
    return out.unionByName(sk.filter("node is null").select("doc_id", "text_key", named.alias("first"), F.lit(1).cast("long").alias("class_size")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of the class), class_size (rows in it)."""
    return members(docs, threshold, id_col, text_col).select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first row of each class (smallest doc_id, then smallest text hash), equal rows once. Rows without an id stay."""
    kept = members(docs, threshold).filter((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).select("doc_id", F.col("text_key").alias("__key")).distinct()
    # The join leaves rows dealt and sorted by both keys, so equal rows meet without another shuffle.
    named = docs.withColumn("__key", text_key("text")).join(kept, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
