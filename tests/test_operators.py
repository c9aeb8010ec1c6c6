import datetime as dt
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgauge import schemas
from pressgauge.operators import coverage as C
from pressgauge.operators import enrich as E
from pressgauge.operators import merge as M
from pressgauge.operators import rollup as R
from pressgauge.operators import search as S
from pressgauge.plans import queries as Q
from pressgauge.sources import listings as L
from pressgauge.sources import outlets as O
from pressgauge.sources import pagestore as P

D1, D2, TODAY = dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2), "2024-03-05"


def every20(start, end):
    out = []
    while start <= end:
        out.append(start)
        start += dt.timedelta(minutes=20)
    return out


def completeness(spark, good, articles, bad=()):
    utc = lambda t: t - dt.timedelta(hours=8)
    runs = spark.createDataFrame([(i, "o", utc(t), ok) for i, (t, ok) in enumerate([(t, True) for t in good] + [(t, False) for t in bad])], "run_id long, outlet string, started_at timestamp_ntz, ok boolean")
    idx = spark.createDataFrame([(i, "o", None, utc(t)) for i, t in enumerate(articles)], "id long, outlet string, published_at timestamp_ntz, seen_at timestamp_ntz")
    got = R.rollup(idx, runs, F.lit(TODAY).cast("date")).collect()
    return {r.day.day: (r.total_articles, r.complete) for r in got}


def at(day, h, m=0):
    return day + dt.timedelta(hours=h, minutes=m)


def test_outage_over_midnight_is_charged_to_the_next_day(spark):
    runs = every20(D1, at(D1, 23, 40)) + [t for t in every20(D2, at(D2, 23, 40)) if t >= at(D2, 1, 20)]
    assert completeness(spark, runs, [at(D1, 12), at(D2, 12)])[2] == (1, False)


def test_covered_day_failed_runs_and_today(spark):
    full = every20(D1, at(D2, 1, 40))
    assert completeness(spark, full, [at(D1, 12)])[1] == (1, True)
    half = [t for t in full if t >= at(D1, 12)]
    assert completeness(spark, half, [at(D1, 15)], every20(D1, at(D1, 11, 40)))[1] == (1, False)
    now = dt.datetime(2024, 3, 5)
    assert completeness(spark, [now, at(now, 0, 20)], [at(now, 0, 10)])[5] == (1, False)


def test_merge(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "e")], "id long, body string, enrich_error string").withColumn("enrich_state", F.lit("failed"))
    u = spark.createDataFrame([(2, "B"), (3, "C")], "id long, body string")
    assert {tuple(r) for r in M.save_enriched(t, u).collect()} == {(1, "a", None, "failed"), (2, "B", None, "fetched"), (3, "C", None, "fetched")}
    f = M.mark_failed(t, spark.createDataFrame([(1, "x" * 3000)], "id long, error string")).filter("id = 1").first()
    assert f.body == "a" and len(f.enrich_error) == 2000
    log = M.run_log(spark.createDataFrame([("a", 3, None), ("b", 0, None), ("c", 2, "boom")], "outlet string, items_seen int, error string")).collect()
    assert [(r.ok, r.error) for r in log] == [(True, None), (False, "0 items seen"), (False, "boom")]


def test_feeds(spark):
    rss = "<rss><item><title>A &amp; B</title><link>https://x/1</link><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item><item><title/><link></link></item></rss>"
    atom = '<feed><entry><title>C</title><link rel="alternate" href="https://x/2"/><updated>2024-01-05T00:00:00Z</updated></entry></feed>'
    feeds = spark.createDataFrame([("o", 0, rss), ("o", 1, rss), ("o", 2, atom), ("o", 3, None)], "outlet string, feed_pos int, body string")
    got = sorted((r.url_original, r.title, r.published_at is not None) for r in L.feed_stubs(feeds).collect())
    assert got == [("https://x/1", "A & B", True), ("https://x/2", "C", True)]
    audit = {r.feed_pos: (r.entries, r.usable, r.with_dates) for r in L.feed_audit(feeds).collect()}
    assert audit == {0: (2, 1, 1), 1: (2, 1, 1), 2: (1, 1, 1), 3: (0, 0, 0)}


def test_listings(spark):
    html = "<a href='/news/1'></a><a href='/news/1'>2025/03/09 18:30:00Big story 7:05</a><a href='/other/9'>no</a><a href='/news/2'></a>"
    pages = spark.createDataFrame([("o", html)], "outlet string, html string")
    got = L.pattern_stubs(pages, "https://l.example/", r"/news/\d+", r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})", True).collect()
    assert [(r.url_original, r.title, r.published_at is not None) for r in got] == [("https://l.example/news/1", "Big story", True)]
    props = '{"initialArticles":[0,{"data":[1,[[0,{"articleId":[0,5],"title":[0,"T"],"publishedAt":[0,1700000000]}],[0,{"title":[0,""]}]]]}]}'.replace('"', "&quot;")
    isl = spark.createDataFrame([("o", f'<astro-island component-url="/RealTimeList.js" props="{props}">'), ("p", "<p>")], "outlet string, html string")
    rows = {r.outlet: r for r in L.island_stubs(isl, "https://l.example/now").collect()}
    assert rows["o"].url_original == "https://l.example/news/5" and rows["o"].published_at and rows["p"].error
    with pytest.raises(ValueError):
        L.stubs_for({"parser": "html", "code": "x"}, pages)


def test_pages(spark, tmp_path):
    p = spark.createDataFrame([("o", "https://x/1", dt.datetime(2024, 1, 1, 12), "中文")], "outlet string, url_canonical string, seen_at timestamp, html string")
    P.write_pages(p, str(tmp_path / "store"))
    assert P.stored(spark, str(tmp_path / "store")).first().html == "中文"
    d = tmp_path / "raw" / "o" / "2024-01-01"
    d.mkdir(parents=True)
    (d / "a.html.gz").write_bytes(gzip.compress("x".encode()))
    (d / "b.html.gz").write_bytes(gzip.compress(b"y" * 500)[:20])
    assert {r.path[-9:]: r.html for r in P.read_pages(spark, str(tmp_path / "raw")).collect()} == {"a.html.gz": "x", "b.html.gz": None}


def test_enrich(spark):
    long = "<article><p>" + "字" * 80 + "</p></article><time datetime='2024-01-01T00:00:00Z'>"
    rows = [(1, long, False), (2, "<article><p>short</p></article>", True), (3, None, False)]
    df = spark.createDataFrame(rows, "id long, html string, from_cache boolean").withColumn("seen_at", F.lit("2024-01-02").cast("timestamp"))
    df = df.withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("timestamp_offset_is_wrong", F.lit(False))
    assert tuple(E.counters(E.enrich(df)).first()) == (3, 1, 1, 1, 2)


def test_search_and_outlets(spark, tmp_path):
    idx = spark.createDataFrame([(1, "a b", 1), (2, "A c", 2), (3, None, 3)], "id long, title_seg string, t int")
    idx = idx.withColumn("seen_at", F.timestamp_seconds("t")).withColumn("published_at", F.lit(None).cast("timestamp"))
    assert [r.id for r in S.search(idx, "a").collect()] == [2, 1] and S.search(idx, "").count() == 0
    f = tmp_path / "o.yaml"
    f.write_text("outlets:\n- {code: a, name_zh: A, home_url: h, parser: rss, verified: true, feed_url: u}\n- {code: b, name_zh: B, home_url: h}\n")
    rows = O.read_outlets(str(f))
    assert rows[0]["feed_urls"] == ["u"] and O.outlets_df(spark, rows).count() == 2
    assert [r["code"] for r in O.select_outlets(rows)] == ["a"]
    with pytest.raises(ValueError):
        O.select_outlets(rows, ["b"])


def test_clusters_and_schema(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9)], "node long")
    assert {r.node: r.component for r in C.components(nodes, links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 8: 8, 9: 8}
    once = schemas.evolve(nodes.withColumnRenamed("node", "id"), schemas.ARTICLES)
    assert schemas.evolve(once, schemas.ARTICLES).schema.names == schemas.ARTICLES.names


def test_clusters_of_close_fingerprints(spark, monkeypatch):
    """Many fingerprints a few bits apart: clusters get links in proportion to them, buckets stay bounded, nothing is lost."""
    rng = np.random.default_rng(3)
    spread = np.uint64(1) << np.arange(2, 14, dtype=np.uint64)
    cube = np.array([spread[[i for i in range(12) if v >> i & 1]].sum(dtype=np.uint64) for v in range(4096)])
    alone = rng.integers(0, 1 << 64, 300, np.uint64)
    chain = alone[:100] ^ np.uint64(0b111 << 50)
    values = np.unique(np.concatenate([cube[rng.random(4096) < 0.7], alone, chain, alone[100:200] ^ np.uint64(0b1111 << 50)]))
    near = [(i, j) for i, v in enumerate(values) for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 3) if i < j]
    signed = [int(v) for v in values.view(np.int64)]
    ids = [*range(len(signed)), *range(len(signed))]  # every document twice
    prints = spark.createDataFrame([(len(ids) - k, signed[i]) for k, i in enumerate(ids)], "doc_id long, simhash long")
    label = np.arange(len(values))
    while True:
        before = label.copy()
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if (before == label).all():
            break
    least = {}
    for k, i in enumerate(ids):
        least[label[i]] = min(len(ids) - k, least.get(label[i], len(ids)))
    links, run = [], C.components
    monkeypatch.setattr(Q, "_prints", lambda spark, d: prints)
    monkeypatch.setattr(C, "components", lambda nodes, given: links.append(given.count()) or run(nodes, given))
    got = {r.doc_id: r.cluster_id for r in Q.near_dup_clusters(spark, "").collect()}
    assert got == {len(ids) - k: least[label[i]] for k, i in enumerate(ids)} and len(near) > 50 * len(values)
    assert links[0] <= 10 * len(values)
    largest = [b.groupBy("mask", "fixed").count().agg(F.max("count")).first()[0] for b in C._buckets(prints)]
    assert len(largest) > 1 and max(largest) <= C.CROWD
    pairs = {tuple(sorted((r.a, r.b))): r.distance for r in C.near_links(prints, "doc_id").collect()}
    assert pairs == {tuple(sorted((signed[i], signed[j]))): int(np.bitwise_count(values[i] ^ values[j])) for i, j in near}


def test_links_of_whole_buckets(spark, monkeypatch):
    """Buckets that go on over batches, and more links than a task holds at a time, give the same components."""
    monkeypatch.setattr(C, "TREE_ROWS", 50)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 20)
    prints = spark.createDataFrame([(i, (i * 37 % 1024) << 20) for i in range(0, 1024, 3)], "doc_id long, simhash long")
    nodes = prints.select(F.col("simhash").alias("node"))
    try:
        a, b = (sorted(map(tuple, C.components(nodes, x).collect())) for x in (C.cluster_links(prints), C.near_links(prints, "doc_id")))
    finally:
        spark.conf.set(key, before)
    assert a == b and len(a) == prints.count()


def test_components_of_paths(spark):
    """A long path, a star and copies of links in both directions; names shrink to the smallest node of each."""
    ends = [(i, i + 1) for i in range(0, 300)] + [(5000, 5000 - i) for i in range(1, 1200)] + [(7, 6), (6, 7), (9000, 9000)]
    got = {r.node: r.component for r in C.components(spark.range(9001).select(F.col("id").alias("node")), spark.createDataFrame(ends, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 300 else 3801 if 3801 <= i <= 5000 else i for i in range(9001)}
    empty = spark.createDataFrame([], "a long, b long")
    assert [tuple(r) for r in C.components(spark.range(1).select(F.col("id").alias("node")), empty).collect()] == [(0, 0)]


def test_components_take_few_queries(spark, monkeypatch):
    """Links that fit a task are followed there: three steps are written, not dozens. More are contracted first, down to that many."""
    ends = [(i, i * 7 % 3001) for i in range(1, 3000, 2)] + [(-5, 9), (-5, -(2**62)), (2**62, 2**62 - 1)]
    links, nodes = spark.createDataFrame(ends, "a long, b long"), spark.createDataFrame([(i,) for e in ends for i in e], "node long")
    up = {i: i for e in ends for i in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in ends:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    steps, save = [], C.saved
    monkeypatch.setattr(C, "saved", lambda df, label="step": steps.append(label) or save(df, label))
    took = []
    for few in (100_000, 600, 0):
        monkeypatch.setattr(C, "FEW_LINKS", few)
        assert {r.node: r.component for r in C.components(nodes, links).collect()} == {i: root(i) for i in up}
        took.append(len(steps) - sum(took))
    assert took[0] <= 3 < took[1] <= took[2]


def test_fingerprints_by_hand(spark):
    """Votes counted in parts of 255 tokens equal the plain count; ties are zeros, rows without a token are left out."""
    texts = ["a", "a b", "b " * 1000 + "c " * 1001, " ".join(f"w{i % 700}" for i in range(5000)), "", None, "É é e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def plain(text):
        h = [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in text.lower().split()]
        v = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
        return v - (1 << 64) if v >> 63 else v

    assert {r.doc_id: r.simhash for r in C.fingerprints(docs, "doc_id", "text").collect()} == {i: plain(t) for i, t in enumerate(texts) if t}


def test_feed_text_and_failures(spark):
    item = "<item><title>It&#8217;s <![CDATA[a < b &amp;]]> &#x4E2D;&nbsp;&bogus; &#99999999; &</title><link>https://x/1</link></item>"
    atom = "<atom:feed><atom:entry><atom:title>N</atom:title><atom:link href='https://x/2'/><media:title>no</media:title></atom:entry></atom:feed>"
    feeds = spark.createDataFrame([("o", 0, item), ("o", 1, None), ("p", 0, atom), ("q", 0, None)], "outlet string, feed_pos int, body string")
    assert sorted((r.outlet, r.title) for r in L.feed_entries(feeds).collect()) == [("o", "It’s a < b &amp; 中\u00a0&bogus; &#99999999; &"), ("p", "N")]
    assert {r.outlet: r.error for r in L.feed_failures(feeds).collect()} == {"o": "1 of 2 feeds failed: 1", "q": "1 of 1 feeds failed: 0"}


def test_migrations(spark):
    old = spark.createDataFrame([("o", dt.date(2024, 1, 1), 5)], "outlet string, day date, total_articles int")
    new, ran = schemas.migrate("outlet_daily_totals", old)
    assert ran == ["001_daily_totals_completeness"] and new.first().complete is False
    again, ran = schemas.migrate("outlet_daily_totals", new.withColumn("complete", F.lit(True)), set(ran))
    assert ran == [] and again.first().complete is True


def test_coverage_with_gaps_in_days(spark):
    """A day without runs: the gap over it is charged to the day of the run that ends it."""
    runs = every20(D1, at(D1, 23, 40)) + [at(D1, 24 * 2 + 1)]
    assert completeness(spark, runs, [at(D1, 12), at(D1, 60)]) == {1: (1, True), 3: (1, False)}
