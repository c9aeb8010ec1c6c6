"""Designed metrics over near-duplicate stories: fingerprints, clusters, propagation, weights, framing."""

from __future__ import annotations

from functools import lru_cache, reduce
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import bands, hamming, sentences, tokens
from ..sources.intermediate import hot_join, hot_keys, saved

#: Totals under this many articles a day are no denominator.
MIN_DENOMINATOR = 20
#: Fingerprints of a bucket that are all compared (512 at least, which a bucket of the last level may hold); rows, and links, that a task holds at a time.
CROWD, TREE_ROWS = 1000, 500_000
#: Links that one task follows to their ends; more are contracted first.
FEW_LINKS = 100_000


@F.arrow_udf(LongType())
def _simhash(tokens: pa.Array) -> pa.Array:
    """Majority bits of the hashes of each row's tokens, as a signed 64-bit number; a word is hashed once a batch.

    A word's bits are 64 bytes, so numpy adds up rows of them: 255 tokens first, which a byte can count, then those sums.
    """
    words = tokens.flatten().dictionary_encode()
    heads = b"".join(md5(w).digest()[:8] for w in words.dictionary.cast(pa.binary()).to_pylist())
    bits = np.unpackbits(np.frombuffer(heads, np.uint8).reshape(-1, 8)[:, ::-1], axis=1, bitorder="little").view(np.uint64)
    word, size = words.indices.to_numpy(), tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    end, out = np.cumsum(size), np.zeros(len(size), np.int64)
    some = np.flatnonzero(size)
    while len(some):
        first = end[some[0]] - size[some[0]]
        now = some[: max(1, int(np.searchsorted(end[some], first + TREE_ROWS, "right")))]
        some = some[len(now) :]
        parts = -(-size[now] // 255)
        head = np.cumsum(parts) - parts
        start = np.repeat(end[now] - size[now] - first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(head, parts))
        sums = np.add.reduceat(bits[word[first : end[now[-1]]]], start, axis=0).view(np.uint8)
        votes = np.add.reduceat(sums, head, axis=0, dtype=np.int64)
        out[now] = np.packbits(2 * votes > size[now][:, None], axis=1, bitorder="little").view(np.int64).ravel()
    return pa.array(out)


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, signed 64-bit simhash (each token occurrence weighs one) and four 16-bit bands; no row without a token.

    A token's hash is the first eight bytes of its MD5, so any engine can follow it. A document is one row and stays one:
    the JVM finds the tokens, one Arrow UDF hashes the different ones and counts votes in the row; nothing is shuffled.
    """
    h = docs.select(key, tokens(F.col(text)).alias("_t")).filter(F.size("_t") > 0)
    return h.select(key, _simhash("_t").alias("simhash")).withColumn("bands", bands(F.col("simhash")))


@lru_cache(maxsize=None)
def _finer(mask: int) -> tuple[int, ...]:
    """Masks of the ten finer buckets that meet every pair of a bucket: its free bits in five blocks, two of them fixed."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(free, 5)]
    return tuple(mask | x | y for x, y in combinations(blocks, 2))


def _cut(batches):
    """(simhash, mask) as ten rows (simhash, mask, fixed), fixed being the bits of the value under the finer mask."""
    for batch in batches:
        value, mask = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
        for m in np.unique(mask):
            v = value[mask == m]
            for finer in np.array(_finer(int(m)), np.uint64):
                columns = v, np.full(len(v), finer), v & finer
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["simhash", "mask", "fixed"])


def _buckets(prints: DataFrame) -> list[DataFrame]:
    """Rows (simhash, mask, fixed), a frame a level: every two fingerprints within three bits share a bucket (mask, fixed).

    Five blocks differ in three at most, so two agree. What a bucket of more than ``CROWD`` fingerprints leaves free is cut
    in the same way; after four levels nine bits are free, so buckets are bounded whatever the fingerprints are. Crowded
    buckets, ten rows in ``CROWD`` at most, travel by broadcast.
    """
    bucket, out = ["mask", "fixed"], []
    left = saved(prints.select("simhash").distinct(), "prints").withColumn("mask", F.lit(0).cast("long"))
    while True:
        cut = left.mapInArrow(_cut, "simhash long, mask long, fixed long")
        cut = saved(cut.distinct(), "cut") if out else cut  # two crowded buckets may lead to one mask
        crowded = saved(cut.groupBy(*bucket).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(*bucket), "crowded")
        if crowded.isEmpty():
            return [*out, cut]
        out.append(cut.join(F.broadcast(crowded), bucket, "left_anti"))
        left = saved(cut.join(F.broadcast(crowded), bucket, "left_semi").select("simhash", "mask"), "left")


def near_links(prints: DataFrame, key: str, max_distance: int = 3) -> DataFrame:
    """Pairs (a, b) of *distinct fingerprints* within ``max_distance`` bits (3 at most), a < b.

    Four 16-bit bands guarantee those pairs too, but such a band holds 1/65536 of all fingerprints, and those of prose lie
    close: candidates would grow with the square of the input. Buckets of bounded size find the same pairs. Equal
    fingerprints are one value, so copies make no pairs.
    """
    if max_distance > 3:
        raise ValueError("blocks guarantee distances up to 3")
    hits = []
    for rows in _buckets(prints):
        a, b = rows.withColumnRenamed("simhash", "a"), rows.withColumnRenamed("simhash", "b")
        hit = a.join(b, ["mask", "fixed"]).filter(F.col("a") < F.col("b")).withColumn("distance", hamming(F.col("a"), F.col("b")))
        hits.append(hit.filter(F.col("distance") <= max_distance).select("a", "b", "distance"))
    return reduce(DataFrame.unionByName, hits).distinct()


def _merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each component) after the links x - y."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _tree(rows: list[np.ndarray], max_distance: int, most: int) -> pa.RecordBatch:
    """Links (a, b) that connect what pairs of the rows' buckets connect: fewer than the rows hold values. Some ``most`` pairs are held."""
    mask, fixed, value = rows
    value, at = np.unique(value, return_inverse=True)
    starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (fixed[1:] != fixed[:-1])]))
    end = np.repeat(np.append(starts[1:], len(mask)), np.diff(np.append(starts, len(mask))))
    label, found, n, lag, row = np.arange(len(value)), [], 0, 0, np.arange(len(mask))
    while len(row):
        lag += 1
        row = row[row + lag < end[row]]
        x, y = at[row], at[row + lag]
        near = (np.bitwise_count(value[x] ^ value[y]) <= max_distance) & (label[x] != label[y])
        found.append((x[near], y[near]))
        n += len(found[-1][0])
        if n > most or not len(row):
            label, found, n = _merged(label, *(np.concatenate(c) for c in zip(*found, strict=True))), [], 0
    other = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(value[i].view(np.int64)) for i in (label[other], other)], ["a", "b"])


def cluster_links(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """Links (a, b) with the components of ``near_links``, as many as there are rows in buckets at most.

    Pairs of close fingerprints grow with the square of the input, a forest over them does not. Whole buckets meet in a
    task, some ``TREE_ROWS`` rows at a time, and only links between values that are still apart are returned. A link says
    that two values are connected, not that they are near.
    """
    if max_distance > 3:
        raise ValueError("blocks guarantee distances up to 3")

    most = TREE_ROWS

    def trees(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            n += batch.num_rows
            if n > most:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])  # this bucket may go on in the next batch
                if not last.all():
                    yield _tree([c[~last] for c in rows], max_distance, most)
                held, n = [[c[last] for c in rows]], int(last.sum())
        if n:
            yield _tree([np.concatenate(c) for c in zip(*held, strict=True)], max_distance, most)

    dealt = [b.select("mask", "fixed", "simhash").repartition("mask", "fixed").sortWithinPartitions("mask", "fixed") for b in _buckets(prints)]
    return reduce(DataFrame.unionByName, [d.mapInArrow(trees, "a long, b long") for d in dealt])


def _followed(batches):
    """(node, component) of all links (x, y) that a task gets."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if held:
        x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        value, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        label = _merged(np.arange(len(value)), at[: len(x)], at[len(x) :])
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(value[label])], ["node", "component"])


def components(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """node, component (smallest node reached), by contraction: nodes take the name at the end of smallest neighbours.

    Pointer jumping finds that end. The links between different names go on, and every name that goes on has taken in
    another, so rounds shrink and their sum is a small multiple of the first. Once ``FEW_LINKS`` are left, one task follows
    them: a round is a dozen queries, whose plans and broadcasts pile up in the driver. Each step is written to the shared
    checkpoint folder: lineage stays short and a lost executor costs one step. Names of hubs and of large components, two
    thousand at most, travel by broadcast. Nodes are integers.
    """
    x, y = F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")
    edges, rounds = saved(links.filter(F.col("a") != F.col("b")).select(x, y).distinct(), "links"), []
    while n := edges.count():
        if n <= FEW_LINKS:
            last = edges.select(F.col("x").cast("long"), F.col("y").cast("long")).repartition(1).mapInArrow(_followed, "node long, component long")
            rounds.append(saved(last.withColumnRenamed("node", node), "labels"))
            break
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        names, moved = saved(both.groupBy(F.col("x").alias(node)).agg(F.min("y").alias("_best")).select(node, F.least(node, "_best").alias("component")), "labels"), True
        while moved:
            jump = names.select(F.col(node).alias("component"), F.col("component").alias("_up"))
            step = saved(hot_join(names, jump, "component", hot_keys(names, "component", n)).select(node, F.col("_up").alias("component"), F.col("component").alias("_was")), "labels")
            names, moved = step.drop("_was"), not step.filter(F.col("component") != F.col("_was")).isEmpty()
        rounds.append(names)
        for end in ("x", "y"):
            named = names.select(F.col(node).alias(end), F.col("component").alias("_name"))
            edges = hot_join(edges, named, end, hot_keys(edges, end, n)).drop(end).withColumnRenamed("_name", end)
        edges = edges.filter(F.col("x") != F.col("y"))
        edges = saved(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    labels = rounds.pop() if rounds else edges.select(F.col("x").alias(node), F.col("y").alias("component"))
    for names in reversed(rounds):
        later = labels.select(F.col(node).alias("component"), F.col("component").alias("_last"))
        last = hot_join(names, later, "component", hot_keys(names, "component", names.count()), "left")
        labels = saved(last.select(node, F.coalesce("_last", "component").alias("component")), "labels")
    return nodes.select(node).distinct().join(labels, node, "left").withColumn("component", F.coalesce("component", node))


def propagation(members: DataFrame, noise_seconds: int = 1200) -> DataFrame:
    """members(cluster_id, id, outlet, at) with cluster_rank, is_origin and origin_confident.

    The origin is confident when the second member came more than ``noise_seconds`` (a poll interval) later.
    """
    w = W.partitionBy("cluster_id").orderBy("at", "id")
    ranked = members.withColumn("cluster_rank", F.row_number().over(w)).withColumn("_next", F.lead("at").over(w))
    lead = F.unix_seconds(F.col("_next").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))
    origin = F.col("cluster_rank") == 1
    return ranked.withColumn("is_origin", origin).withColumn("origin_confident", F.when(origin, F.coalesce(lead > noise_seconds, F.lit(True)))).drop("_next")


def coverage_weight(incident: DataFrame, totals: DataFrame) -> DataFrame:
    """incident(outlet, day, n) over complete days of at least 20 articles; the weight is NULL elsewhere."""
    fine = F.col("complete") & (F.col("total_articles") >= MIN_DENOMINATOR)
    j = totals.join(incident, ["outlet", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.withColumn("weight", F.when(fine, F.col("n") / F.col("total_articles"))).select("outlet", "day", "n", "total_articles", "complete", "weight")


def originality(articles: DataFrame, by: str) -> DataFrame:
    """Share of an outlet's articles outside any duplicate cluster."""
    return articles.groupBy(by).agg(F.count("*").alias("articles"), (1 - F.count_if(F.col("cluster_id").isNotNull()) / F.count("*")).alias("originality_rate"))


def framing_delta(text: Column, origin: Column) -> tuple[Column, Column, Column]:
    """(added, removed, shared) sentences of a copy against its origin."""
    a, b = sentences(text), sentences(origin)
    return F.array_except(a, b), F.array_except(b, a), F.array_intersect(a, b)


def shared_core(members: DataFrame, cluster: str = "cluster_id", text: str = "text") -> DataFrame:
    """Sentences that every member of a cluster holds, sorted: cluster, members, shared_core_text.

    Counted as (cluster, sentence) rows with a map-side combine, so no task holds a cluster's texts.
    """
    size = members.groupBy(cluster).agg(F.count("*").alias("members"))
    each = members.select(cluster, F.explode(F.array_distinct(sentences(F.col(text)))).alias("s")).groupBy(cluster, "s").agg(F.count("*").alias("n"))
    common = each.join(size, cluster).filter(F.col("n") == F.col("members")).groupBy(cluster).agg(F.sort_array(F.collect_list("s")).alias("core"))
    return size.join(common, cluster, "left").select(cluster, "members", F.array_join(F.coalesce("core", F.array().cast("array<string>")), "\n").alias("shared_core_text"))


def label_distribution(rows: DataFrame, by: list[str], label: str, values: list) -> DataFrame:
    """Share of each label value per group; the values are given, so no extra pass finds them."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == v).alias(f"n_{v}") for v in values])
    return counts.select(*by, "n", *[(F.col(f"n_{v}") / F.col("n")).alias(f"share_{v}") for v in values])


def relative_to_baseline(totals: DataFrame, by: str = "outlet", value: str = "total_articles") -> DataFrame:
    """Each day's total over the outlet's mean total (all days of the input)."""
    mean = totals.groupBy(by).agg(F.avg(value).alias("baseline"))
    return totals.join(mean, by).withColumn("relative", F.col(value) / F.col("baseline"))
