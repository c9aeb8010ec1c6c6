"""One query per operator, on stand-ins drawn from the driver's tables (see ``sources.tables``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import registry
from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U
from ..operators import coverage as C
from ..operators import crawl as K
from ..operators import enrich as E
from ..operators import merge as M
from ..operators import rollup as R
from ..operators import search as S
from ..sources import listings as L
from ..sources import pagestore as P
from ..sources.intermediate import hot_join, hot_keys, saved
from ..sources.tables import articles, runs, table

AS_OF = "2024-01-31"
_day = lambda: F.date_format("day", "yyyy-MM-dd").alias("day")
_sec = lambda c: R.seconds(F.col(c) if isinstance(c, str) else c)


def _as_of(hour: int = 0):
    return F.lit(f"{AS_OF} {hour:02d}:00:00").cast("timestamp_ntz")


def _rolled(spark, d):
    return R.rollup(articles(spark, d), runs(spark, d), F.lit(AS_OF).cast("date"))


def daily_totals(spark, d):
    return R.daily_totals(articles(spark, d)).select("outlet", _day(), "total_articles")


def trailing_totals(spark, d):
    since = F.lit("2024-01-23 16:00:00").cast("timestamp_ntz")  # a local midnight
    return R.daily_totals(articles(spark, d), since).select("outlet", _day(), "total_articles")


def day_coverage(spark, d):
    c = R.day_coverage(runs(spark, d))
    return c.select("outlet", _day(), _sec("first_run").alias("first_run_s"), _sec("last_run").alias("last_run_s"), "max_gap_us")


def daily_completeness(spark, d):
    return _rolled(spark, d).select("outlet", _day(), "total_articles", "complete")


def completeness_summary(spark, d):
    return R.completeness_summary(_rolled(spark, d))


def rollup_upsert(spark, d):
    stored = _rolled(spark, d).filter(F.col("day") < F.lit("2024-01-20").cast("date"))
    fresh = _rolled(spark, d).filter(F.col("day") >= F.lit("2024-01-15").cast("date")).withColumn("total_articles", F.col("total_articles") + 1)
    return M.upsert(stored, fresh, ["outlet", "day"]).select("outlet", _day(), "total_articles", "complete")


def crawl_health_24h(spark, d):
    return R.crawl_health(runs(spark, d), _as_of())


def health_with_silent(spark, d):
    silent = runs(spark, d).select("outlet").distinct().unionByName(spark.createDataFrame([("silent",)], "outlet string"))
    return R.health_with_silent(runs(spark, d), silent, _as_of())


def failed_runs_text(spark, d):
    return R.failed_runs(runs(spark, d), _as_of())


def effective_at_rule(spark, d):
    return articles(spark, d).select("id", _sec(D.effective_at(F.col("published_at"), F.col("seen_at"))).alias("effective_s"))


def _sightings(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("outlet"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("seen_at"))


def first_sight_dedup(spark, d):
    s = _sightings(spark, d)
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    old = L.keep_first(s.filter(F.col("seen_at") < cut), ["outlet", "url"], ["seen_at", "id"])
    return M.insert_if_absent(old, s.filter(F.col("seen_at") >= cut), ["outlet", "url"], ["seen_at", "id"]).select("outlet", "url", "id", _sec("seen_at").alias("seen_s"))


def seen_and_new(spark, d):
    s = _sightings(spark, d)
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return M.seen_and_new(s.filter(F.col("seen_at") < cut), s.filter(F.col("seen_at") >= cut), ["outlet", "url"])


def upsert_update_policy(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"), F.col("c_mktsegment").alias("enrich_error"))
    stored = c.filter(F.col("id") % 3 != 0).withColumn("enrich_state", F.lit("failed"))
    rerun = c.filter(F.col("id") % 2 == 0).select("id", F.upper("body").alias("body"))
    return M.save_enriched(stored.select("id", "body", "enrich_state", "enrich_error"), rerun)


def mark_failed(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"))
    stored = c.filter(F.col("id") % 3 != 0).withColumn("enrich_state", F.lit("fetched")).withColumn("enrich_error", F.lit(None).cast("string"))
    bad = c.filter(F.col("id") % 5 == 0).select("id", F.repeat("body", 200).alias("error"))
    return M.mark_failed(stored, bad)


def flag_fetched(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(False).alias("body_fetched"))
    return M.flag_fetched(c, c.filter(F.col("id") % 4 == 0))


def outlet_refresh(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name_zh"), F.lower("n_name").alias("home_url"))
    stored = n.filter(F.col("code").cast("int") < 20).withColumn("active", F.col("code").cast("int") % 2 == 0)
    return M.refresh_outlets(stored, n.filter(F.col("code").cast("int") >= 10).withColumn("name_zh", F.concat("name_zh", F.lit("*"))))


def run_judgement(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("outlet")).agg(F.count_if(F.col("value") >= 12).alias("items_seen"))
    bad = F.when(F.col("outlet") % 17 == 0, F.repeat(F.lit("timeout "), 400))
    return M.run_log(e.withColumn("error", bad)).select("outlet", "items_seen", "ok", "error")


def backfill_published(spark, d):
    a = articles(spark, d).select("id", "published_at", "seen_at")
    rec = a.filter(F.col("id") % 2 == 0).select("id", (F.col("seen_at") - F.make_dt_interval(hours=F.lit(1))).alias("published_at"))
    b = M.backfill_published(a, rec)
    return b.select("id", _sec("published_at").alias("published_s"), _sec(D.effective_at(F.col("published_at"), F.col("seen_at"))).alias("effective_s"))


def stale_feeds(spark, d):
    a = articles(spark, d).withColumn("feed_pos", F.col("id") % 40)
    s = L.stale_feeds(a.filter((F.col("feed_pos") > 5) | (F.col("seen_at") < F.lit("2024-01-20").cast("timestamp_ntz"))), _as_of())
    return s.select("outlet", "feed_pos", _sec("newest").alias("newest_s"), "stale")


def keep_first_link(spark, d):
    s = _sightings(spark, d).withColumn("feed_pos", F.col("id") % 3)
    return L.keep_first(s, ["outlet", "url"], ["feed_pos", "id"]).select("outlet", "url", "feed_pos", "id")


def longest_title_per_url(spark, d):
    p = table(spark, d, "part")
    links = p.select(
        F.col("p_brand").alias("outlet"), (F.col("p_size") % 10).cast("string").alias("url"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("title"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).alias("published_at"),
    )
    return L.longest_title(links)


def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonicalize(F.col("url")).alias("url_canonical"))


def distinct_canonical_urls(spark, d):
    return table(spark, d, "pages").agg(F.count("*").alias("items_seen"), F.count_distinct(U.canonicalize(F.col("url"))).alias("items_new"))


def url_cache_key(spark, d):
    seen = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("page_id") % 240).cast("int"))
    return table(spark, d, "pages").select("page_id", U.cache_path(U.host_of(F.col("url")), F.col("url"), seen).alias("path"))


def page_hosts(spark, d):
    return table(spark, d, "pages").groupBy(U.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def cache_first(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("path"), "html")
    got = P.cache_first(p.select("path"), p.filter(F.col("path") % 2 == 0), p.filter(F.col("path") % 3 == 0))
    return got.select("path", "from_cache", F.length("html").alias("html_chars"))


def strip_trailing_clock(spark, d):
    k = F.col("p_partkey")
    clock = F.concat((k % 130).cast("string"), F.lit(":"), (k % 75).cast("string"))
    title = F.when(k % 3 == 0, F.concat("p_name", F.lit("  "), clock)).when(k % 3 == 1, F.concat(clock, F.lit(" "), "p_name")).otherwise(F.concat("p_name", clock, F.lit(" "), "p_type"))
    return table(spark, d, "part").select("p_partkey", T.strip_trailing_clock(title).alias("title"))


def _stamp(fmt):
    return F.date_format("o_orderdate", fmt)


def datetime_prefix(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, _stamp("yyyy/MM/dd HH:mm:ss")).otherwise(""), F.lit(" "), F.col("o_orderpriority")).alias("title"))
    title, at = T.split_datetime_prefix(F.col("title"), r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})")
    return o.select("o_orderkey", U.strip(title).alias("title"), F.unix_seconds(at).alias("published_s"))


def listing_datetime(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, _stamp("yyyy/MM/dd HH:mm:ss")).when(k == 1, _stamp("yyyy/MM/dd HH:mm")).when(k == 2, _stamp("yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("yesterday"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(D.listing_datetime(text)).alias("published_s"))


def feed_datetime(spark, d):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(_stamp("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0800"))).when(k == 1, F.concat(_stamp("dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(D.feed_datetime(text)).alias("published_s"))


def free_datetime(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))).when(k == 1, F.concat(_stamp("yyyy-MM-dd HH:mm"), F.lit(" +00:00"))).when(k == 2, _stamp("yyyy/MM/dd HH:mm:ss")).otherwise(F.lit("soon"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(D.free_datetime(text)).alias("published_s"), F.unix_seconds(D.free_datetime(text, F.lit(True))).alias("clock_kept_s"))


def first_acceptable_time(spark, d):
    o = table(spark, d, "orders")
    shift = F.make_dt_interval(hours=F.when(F.col("o_orderkey") % 2 == 0, 8).otherwise(-1))
    times = F.array(F.lit("?"), F.date_format(F.col("o_orderdate") + shift, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.date_format(F.col("o_orderdate") - F.make_dt_interval(hours=F.lit(3)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("o_orderkey", F.unix_seconds(D.first_acceptable(times, F.col("o_orderdate").cast("timestamp"))).alias("published_s"))


def epoch_seconds(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(D.epoch(F.col("event_id") * 3600), "yyyy-MM-dd HH:mm:ss").alias("at"))


def title_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.tokens(F.col("p_name")), " ").alias("title_seg"))


def _searchable(spark, d):
    t = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("title_seg"), F.lit(None).cast("timestamp_ntz").alias("published_at"), (t + F.make_dt_interval(mins=(F.col("doc_id") % 1000).cast("int"))).alias("seen_at"))


def title_search_topk(spark, d):
    return S.search(_searchable(spark, d), "the with", 200).select("id", _sec("effective_at").alias("effective_s"))


def title_search_rank(spark, d):
    return S.search(_searchable(spark, d), "the of", 50).select("id", F.round("rank", 9).alias("rank"))


def search_empty(spark, d):
    """A blank keyword adds no rows to those of a real one."""
    docs = _searchable(spark, d)
    return S.search(docs, "  ", 200).unionByName(S.search(docs, "la", 20)).select("id", _sec("effective_at").alias("effective_s"))


def token_postings(spark, d):
    return S.inverted_index(table(spark, d, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("postings"))


def resegment(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_name", "p_type", "p_size").alias("p_name"), F.lit("old").alias("title_seg"))
    part = part.withColumn("p_name", F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")))
    return S.resegment(part, "p_name", "title_seg", ("cold widget", "small bolt"), "p_partkey").select("p_partkey", "title_seg")


def listing_links(spark, d):
    a = table(spark, d, "pages").select("page_id", F.explode(H.extract_anchors("html")).alias("a"))
    return a.filter(F.col("a.href").rlike("^/[A-Za-z]+$")).groupBy("page_id").agg(F.count("*").alias("links"), F.min("a.href").alias("first_href"))


def pattern_listing(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("outlet"), "html")
    return L.pattern_stubs(pages, "https://listing.example.com/now/", r"^/\w+").select("outlet", "url_original", "title")


def body_extract(spark, d):
    b = table(spark, d, "pages").select("page_id", H.extract_body("html").alias("body"))
    return b.select("page_id", F.length("body").alias("body_chars"), F.sha2("body", 256).alias("body_sha256"))


def _built(spark, d):
    """Pages made from ``part``: chrome inside an article, a marked body, dense blocks, or none; times of five kinds."""
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    words = F.repeat(F.concat(name, F.lit(" ")), F.col("p_size"))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit("<div>x</div><ARTICLE><nav>menu</nav><p>"), words, F.lit("</p><p> <style>p{}</style> </p><p><b>"), kind, F.lit("</b><script>no()</script>!</p></ARTICLE>")))
        .when(k % 4 == 1, F.concat(F.lit("<p>no</p><section itemprop=articleBody><aside>ad</aside>"), words, F.lit("<i>"), kind, F.lit("</i></section>")))
        .when(k % 4 == 2, F.concat(F.lit("<div>"), kind, F.lit("</div><div><h1>"), name, F.lit("</h1><p>"), words, F.lit("</p></div>")))
        .otherwise(F.concat(F.lit("<p>"), words, F.lit("</p>")))
    )
    at = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    ld = F.when(k % 7 == 0, F.concat(F.lit('{"datePublished": "'), at, F.lit('T08:00:00+08:00"}'))).when(k % 7 == 1, F.concat(F.lit('[3, {"datePublished": "'), at, F.lit('T09:00:00Z"}, {}]'))).otherwise(F.lit("{bad"))
    head = F.concat(
        F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"),
        F.when(k % 5 < 2, F.concat(F.lit('<meta property="og:article:published_time" content="'), at, F.lit(' 10:00:00">'))).otherwise(""),
        F.when(k % 5 == 1, F.concat(F.lit('<meta property="article:published_time" content="'), at, F.lit(' 11:00:00">'))).otherwise(""),
        F.when(k % 5 == 2, F.concat(F.lit('<meta name="pubdate" content="'), at, F.lit(' 12:00:00">'))).otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit("<time datetime='"), at, F.lit("T13:00:00+00:00'>t</time>"))).otherwise(""),
    )
    return table(spark, d, "part").select(k, name, kind, F.col("p_size"), F.concat(head, body).alias("html"))


def article_body(spark, d):
    return _built(spark, d).select("p_partkey", H.extract_body("html").alias("body"))


def article_times(spark, d):
    return _built(spark, d).select("p_partkey", F.array_join(H.published_candidates("html"), "|").alias("times"))


def _tier2(spark, d):
    b = _built(spark, d)
    k, seen = F.col("p_partkey"), F.lit("2024-01-14 12:00:00").cast("timestamp")
    url = F.concat(F.lit("https://x.example/"), k.cast("string"))
    index = b.select(
        k.alias("id"), F.when(k % 2 == 0, "a").otherwise("b").alias("outlet"), url.alias("url_canonical"), url.alias("url_original"), F.col("p_name").alias("title"),
        F.col("p_name").alias("title_seg"), F.when(k % 6 == 0, seen).alias("published_at"), seen.alias("seen_at"), F.lit(False).alias("body_fetched"),
    )
    pages = index.select("id", U.cache_path(F.col("outlet"), F.col("url_canonical"), F.col("seen_at")).alias("path")).join(b.select(k.alias("id"), "html"), "id")
    old = b.filter(k % 8 == 0).select(k.alias("id"), F.lit("old").alias("body"), F.lit(None).cast("string").alias("body_seg"), F.lit(None).cast("string").alias("raw_html_path"), F.lit("fetched").alias("enrich_state"), F.lit(None).cast("string").alias("enrich_error"))
    outlets = spark.createDataFrame([("a", False), ("c", True)], "code string, timestamp_offset_is_wrong boolean")
    return E.enrich_keyword(index, old, pages.filter(F.col("id") % 3 == 0).drop("id"), pages.filter(F.col("id") % 5 != 0).drop("id"), outlets, "widget", 1_000_000)


def enrich_outcomes(spark, d):
    o = _tier2(spark, d)["outcomes"]
    return o.select("id", "from_cache", "state", "error", "backfills", F.unix_seconds("recovered_at").alias("recovered_s"), F.length("body").alias("body_chars"))


def enrich_counters(spark, d):
    return _tier2(spark, d)["counters"]


def enrich_tables(spark, d):
    t = _tier2(spark, d)
    index = t["index"].select("id", "body_fetched", F.unix_seconds("published_at").alias("published_s"))
    return index.join(t["articles"].select("id", F.length("body").alias("body_chars"), "enrich_state", F.col("enrich_error").isNotNull().alias("has_error")), "id", "left")


def island_listing(spark, d):
    k = F.col("p_partkey")
    props = F.concat(
        F.lit('{"initialArticles":[0,{"data":[1,[[0,{"articleId":[0,'), k.cast("string"), F.lit('],"title":[0," '), "p_name", F.lit('"],"articleUrl":[0,"'), F.when(k % 2 == 0, F.concat(F.lit("/a/../b/"), "p_type")).otherwise(""),
        F.lit('"],"publishedAt":[0,'), F.when(k % 3 == 0, F.lit('"soon"')).otherwise((k + 1_700_000_000).cast("string")), F.lit(']}],[0,{"articleId":[0,7],"title":[0," "]}],"odd"]]}]}'),
    )
    html = F.when(k % 5 == 0, F.lit("<p>no component</p>")).otherwise(F.concat(F.lit('<astro-island component-url="/x/RealTimeList.js" props="'), F.replace(props, F.lit('"'), F.lit("&quot;")), F.lit('"></astro-island>')))
    pages = table(spark, d, "part").select(k.cast("string").alias("outlet"), html.alias("html"))
    got = L.island_stubs(pages, "https://l.example/now/")
    return got.select("outlet", "url_original", "title", F.unix_seconds("published_at").alias("published_s"), "error")


def _section_feeds(spark, d):
    """Feeds of ``nation``, three for each region, with entities, CDATA, empty entries, unusable dates and feeds that are down."""
    k = F.col("n_nationkey")
    date = F.when(k % 3 == 0, "Fri, 05 Jan 2024 10:00:00 +0800").when(k % 3 == 1, "2024-01-05T02:00:00Z").otherwise("Thu, 01 Jan 1970 00:00:00 GMT")
    item = F.concat(F.lit("<item><title>It&#8217;s <![CDATA["), F.col("n_name"), F.lit(" & co]]> &amp; &#x4E2D;</title><link>https://x.example/"), (k % 7).cast("string"), F.lit("?utm_source=a</link><pubDate>"), date, F.lit("</pubDate></item>"))
    hollow = F.when(k % 2 == 0, "<item><title> </title><link></link></item>").otherwise("")
    body = F.concat(F.lit("<rss><channel>"), item, hollow, F.lit("</channel></rss>"))
    return table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("outlet"), k.alias("feed_pos"), F.when(k % 11 != 10, body).alias("body"))


def feed_entries(spark, d):
    e = L.feed_entries(_section_feeds(spark, d))
    return e.select("outlet", "feed_pos", "entry_pos", "link", "title", F.unix_seconds("published_at").alias("published_s"))


def feed_audit(spark, d):
    return L.feed_audit(_section_feeds(spark, d))


def audit_groups(spark, d):
    return L.audit_groups(L.feed_audit(_section_feeds(spark, d)))


def _tier1(spark, d):
    feeds = _section_feeds(spark, d)
    stubs = L.feed_stubs(feeds).withColumn("seen_at", F.lit("2024-01-06").cast("timestamp"))
    known = spark.createDataFrame([("r0", "https://x.example/0"), ("r1", "https://x.example/1")], "outlet string, url_canonical string")
    outlets = feeds.select("outlet").unionByName(spark.createDataFrame([("silent",)], "outlet string"))
    new = K.ingest(stubs, known)
    return new, K.log(outlets, stubs, new, L.feed_failures(feeds))


def crawl_new_rows(spark, d):
    return _tier1(spark, d)[0].select("outlet", "url_canonical", "url_original", "title_seg")


def crawl_run_log(spark, d):
    return _tier1(spark, d)[1].select("outlet", "items_seen", "items_new", "ok", "error")


def crawl_outcome(spark, d):
    return K.outcome(_tier1(spark, d)[1])


def charset_repair(spark, d):
    k, text = F.col("p_partkey"), F.concat("p_name", F.lit(" 新聞 é"))
    gbk = F.concat(F.encode(F.concat("p_name", F.lit(" ")), "UTF-8"), F.unhex(F.lit("D0C2C284")))
    files = table(spark, d, "part").select(k, F.when(k % 2 == 0, F.encode(text, "UTF-8")).otherwise(gbk).alias("content"))
    return P.decoded(files, "ISO-8859-1").select("p_partkey", "text")


def page_store(spark, d):
    """Stored pages read back; a truncated member is a miss."""
    p = table(spark, d, "pages").select("page_id", P.gzip_bytes("html").alias("z"))
    cut = F.when(F.col("page_id") % 4 == 0, F.expr("substring(z, 1, length(z) - 9)")).otherwise(F.col("z"))
    back = p.select("page_id", P.gunzip(cut).alias("html"))
    return back.select("page_id", F.sha2("html", 256).alias("html_sha256"))


def sql_functions(spark, d):
    """The registered functions, called from SQL."""
    registry.register(spark)
    table(spark, d, "part").createOrReplaceTempView("pressgauge_part")
    return spark.sql("""SELECT p_partkey, segment_text(p_name || ',' || p_type) AS seg, article_body('<article><p>' || p_name || '</p></article>') AS body,
        lenient_date('Jan 5, 2024 9:00 AM') AS stamp FROM pressgauge_part""")


def lenient_datetime(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat(_stamp("MMM d, yyyy"), F.lit(" 9:30 PM"))).when(k == 1, F.concat(_stamp("d MMMM yyyy"), F.lit(" 09:00"))).when(k == 2, F.concat(_stamp("yyyyMMdd"), F.lit("T090000Z")))
    text = text.when(k == 3, F.concat(F.lit("Sun "), _stamp("MMM dd"), F.lit(" 09:00:00 "), _stamp("yyyy"))).otherwise(F.lit("9:00"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(D.free_datetime(H.lenient_date(text))).alias("published_s"))


def resolved_links(spark, d):
    k = F.col("p_partkey") % 6
    href = F.when(k == 0, F.concat(F.lit(" ../"), "p_type")).when(k == 1, F.concat(F.lit("/a/./b/../"), "p_type", F.lit("?q=../x"))).when(k == 2, F.concat(F.lit("../../../"), "p_type", F.lit("#s")))
    href = href.when(k == 3, F.concat(F.lit("//c.example/../"), "p_type")).when(k == 4, F.concat(F.lit("https://d.example/"), "p_type", F.lit("/.."))).otherwise(F.concat("p_type", F.lit("/..")))
    return table(spark, d, "part").select("p_partkey", U.resolve("https://l.example/x/y/z?p=1", href).alias("url"))


def canonical_forms(spark, d):
    """Odd forms of a URL: ports, schemes, slashes, userinfo, fragments and tracking keys."""
    k, name = F.col("p_partkey") % 8, F.col("p_type")
    url = F.when(k == 0, F.concat(F.lit("http://WWW.a.example:80/"), name, F.lit("//#f"))).when(k == 1, F.concat(F.lit("//u:p@a.example:443/"), name)).when(k == 2, F.concat(F.lit("ftp://a.example:443/"), name, F.lit("?FROM=x&b=&a=1")))
    url = url.when(k == 3, F.concat(F.lit("https://a.example:0/"), name)).when(k == 4, "https://a.example//").when(k == 5, F.concat(F.lit("https://a.example:80/"), name)).when(k == 6, F.concat(F.lit(" "), name, F.lit(" "))).otherwise(F.concat(F.lit("https://a.example?z=1&utm_x=2&y="), name))
    return table(spark, d, "part").select("p_partkey", U.canonicalize(url).alias("url_canonical"))


def shared_core(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("cluster_id"), F.concat(F.lit("Same start. "), F.substring("text", 1, 300), F.when(F.col("doc_id") % 50 < 25, "\nSame end!").otherwise("")).alias("text"))
    return C.shared_core(docs)


def streamed_totals(spark, d):
    """Day totals computed by a streaming query over the events, read from its memory sink."""
    from ..streaming.crawl import streaming_daily_totals

    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    stream = e.select(F.col("event_type").alias("outlet"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.col("ts").alias("seen_at"))
    q = streaming_daily_totals(stream).writeStream.format("memory").queryName("pressgauge_totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    t = spark.table("pressgauge_totals")
    return t.select("outlet", F.date_format(F.col("day_window.start") + F.expr("interval 8 hours"), "yyyy-MM-dd").alias("day"), "total_articles")


def outlet_offset_lookup(spark, d):
    dim = table(spark, d, "nation").filter(F.col("n_nationkey") < 20).select(F.col("n_nationkey").alias("code"), (F.col("n_regionkey") == 2).alias("timestamp_offset_is_wrong"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("outlet"))
    return E.offsets(c, dim).select("id", "timestamp_offset_is_wrong")


def coverage_weight(spark, d):
    a = articles(spark, d)
    incident = R.daily_totals(a.filter(F.col("id") % 10 == 0)).withColumnRenamed("total_articles", "n")
    return C.coverage_weight(incident, _rolled(spark, d)).select("outlet", _day(), "n", "total_articles", "complete", "weight")


def baseline_relative(spark, d):
    return C.relative_to_baseline(_rolled(spark, d)).select("outlet", _day(), "total_articles", F.round("relative", 9).alias("relative"))


def _copies(spark, d):
    docs = table(spark, d, "documents")
    t = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("doc_id").cast("int") * 7)
    return docs.select(F.xxhash64("text").alias("cluster_id"), F.sha2("text", 256).alias("text_key"), F.col("doc_id").alias("id"), F.col("source").alias("outlet"), t.alias("at"))


def propagation_rank(spark, d):
    return C.propagation(_copies(spark, d)).select("text_key", "id", "cluster_rank", "is_origin", "origin_confident")


def originality_rate(spark, d):
    c = _copies(spark, d).select("outlet", "cluster_id")
    several = c.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n > 1").select("cluster_id", F.lit(True).alias("copied"))
    marked = c.join(several, "cluster_id", "left")
    return C.originality(marked.withColumn("cluster_id", F.when(F.col("copied"), F.col("cluster_id"))), "outlet")


def _prints(spark, d):
    return C.fingerprints(table(spark, d, "documents"), "doc_id", "text")


def simhash_prints(spark, d):
    return _prints(spark, d).select("doc_id", "simhash", *[F.col("bands")[i].alias(f"band{i}") for i in range(4)])


def near_dup_pairs(spark, d):
    return C.near_links(_prints(spark, d), "doc_id")


def near_dup_clusters(spark, d):
    p = saved(_prints(spark, d), "prints")
    comp = C.components(p.select(F.col("simhash").alias("node")), C.cluster_links(p))
    docs, n = p.select("doc_id", F.col("simhash").alias("node")), p.count()
    of = saved(hot_join(docs, comp, "node", hot_keys(docs, "node", n)).select("doc_id", "component"), "components")
    least = of.groupBy("component").agg(F.min("doc_id").alias("cluster_id"))
    return hot_join(of, least, "component", hot_keys(of, "component", n)).select("doc_id", "cluster_id")


def framing_delta(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    origin = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("origin"))
    added, removed, shared = C.framing_delta(F.col("text"), F.col("origin"))
    return docs.join(origin, "doc_id").select("doc_id", F.size(added).alias("n_added"), F.size(removed).alias("n_removed"), F.size(shared).alias("n_shared"))


def stance_distribution(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return C.label_distribution(j, ["source"], "quality", [0, 1])


QUERIES = {f.__name__: f for f in (
    daily_totals, trailing_totals, day_coverage, daily_completeness, completeness_summary, rollup_upsert, crawl_health_24h, health_with_silent,
    failed_runs_text, effective_at_rule, first_sight_dedup, seen_and_new, upsert_update_policy, mark_failed, flag_fetched, outlet_refresh,
    run_judgement, backfill_published, stale_feeds, keep_first_link, longest_title_per_url, canonical_url, distinct_canonical_urls, url_cache_key,
    page_hosts, cache_first, strip_trailing_clock, datetime_prefix, listing_datetime, feed_datetime, free_datetime, first_acceptable_time,
    epoch_seconds, title_tokens, title_search_topk, search_empty, token_postings, resegment, listing_links, pattern_listing, body_extract,
    outlet_offset_lookup, coverage_weight, baseline_relative, propagation_rank, originality_rate, simhash_prints, near_dup_pairs,
    near_dup_clusters, framing_delta, stance_distribution, feed_audit, title_search_rank, article_body, article_times, enrich_outcomes,
    enrich_counters, enrich_tables, island_listing, feed_entries, audit_groups, crawl_new_rows, crawl_run_log, crawl_outcome, charset_repair,
    page_store, sql_functions, lenient_datetime, resolved_links, canonical_forms, shared_core, streamed_totals,
)}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return daily_completeness(spark, d)
