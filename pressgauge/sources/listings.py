"""Listing sources: feeds, link patterns and component props, all giving the stub schema.

Input frames hold documents, not network handles: ``feeds(outlet, feed_pos, body)`` and ``pages(outlet, html)``.
Fetching is outside the engine; a failed source arrives with a NULL body and an error text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import split_datetime_prefix, strip_trailing_clock
from ..functions.times import epoch, feed_datetime
from ..functions.urls import resolve, strip

_ITEM = r"(?is)<(?:\w+:)?(?:item|entry)[\s>].*?</(?:\w+:)?(?:item|entry)>"
# Entities of XML and those that headlines use most.
_NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£",
}


def _xml_text(c):
    """Character data: CDATA sections as they are, entities between them (numbers, and names that are known) decoded once."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|&#?\w+;|[^&<]+|[&<]"), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv])

    def number(code, base):
        text = F.decode(F.unhex(F.lpad(F.conv(code, base, 16), 8, "0")), "UTF-32")
        value = F.conv(code, base, 10).try_cast("long")
        return F.when(value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF), text)

    def plain(p):
        known = (
            F.when(p.startswith("<![CDATA["), F.substring(p, F.lit(10), F.length(p) - 12))
            .when(p.rlike("^&#[0-9]{1,7};$"), number(F.regexp_extract(p, "([0-9]+)", 1), 10))
            .when(p.rlike("^&#[xX][0-9A-Fa-f]{1,6};$"), number(F.regexp_extract(p, "[xX]([0-9A-Fa-f]+)", 1), 16))
            .when(p.rlike("^&[A-Za-z]+;$"), F.try_element_at(names, F.regexp_extract(p, "([A-Za-z]+)", 1)))
        )
        return F.coalesce(known, p)

    return strip(F.array_join(F.transform(pieces, plain), ""))


def _tag(item, *names):
    found = [F.regexp_extract(item, rf"(?is)<(?:atom:|rss:)?{n}(?:\s[^>]*)?>(.*?)</(?:atom:|rss:)?{n}>", 1) for n in names]
    return F.coalesce(*[F.when(x != "", _xml_text(x)) for x in found], F.lit(""))


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Every entry of RSS and Atom documents: outlet, feed_pos, entry_pos, link, title, published_at."""
    e = feeds.select("outlet", "feed_pos", F.posexplode(F.regexp_extract_all("body", F.lit(_ITEM), F.lit(0))).alias("entry_pos", "item"))
    atom = _xml_text(F.regexp_extract("item", r"(?is)<(?:atom:)?link\s[^>]*href=[\"']([^\"']*)", 1))
    link = _tag(F.col("item"), "link")
    return e.select(
        "outlet", "feed_pos", "entry_pos", F.when(link != "", link).otherwise(atom).alias("link"), _tag(F.col("item"), "title").alias("title"),
        feed_datetime(_tag(F.col("item"), "pubDate", "published", "dc:date", "updated")).alias("published_at"),
    )


def usable(entries: DataFrame) -> DataFrame:
    return entries.filter((F.col("link") != "") & (F.col("title") != ""))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``: an aggregate with map-side combine, not a window over whole groups."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.min_by(F.struct(*rest, *order), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)


def feed_stubs(feeds: DataFrame) -> DataFrame:
    """Stubs of all feeds of each outlet; a link in several feeds is kept once, the first wins."""
    first = keep_first(usable(feed_entries(feeds)), ["outlet", "link"], ["feed_pos", "entry_pos"])
    return first.select("outlet", F.col("link").alias("url_original"), "title", "published_at")


def feed_audit(feeds: DataFrame) -> DataFrame:
    """Entries, usable entries and usable entries with a believable date of every feed, empty feeds included."""
    good = (F.col("link") != "") & (F.col("title") != "")
    counts = feed_entries(feeds).groupBy("outlet", "feed_pos").agg(
        F.count("*").alias("entries"), F.count_if(good).alias("usable"), F.count_if(good & (F.year("published_at") > 1971)).alias("with_dates")
    )
    zero = {c: 0 for c in ("entries", "usable", "with_dates")}
    return feeds.select("outlet", "feed_pos").join(counts, ["outlet", "feed_pos"], "left").fillna(zero)


def feed_failures(feeds: DataFrame) -> DataFrame:
    """Outlets with a feed that did not arrive (no body): outlet, error naming how many and which. The other feeds count."""
    down = feeds.groupBy("outlet").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("body").isNull(), F.col("feed_pos")))).alias("failed"))
    text = F.concat(F.size("failed").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" feeds failed: "), F.array_join(F.transform("failed", lambda x: x.cast("string")), ", "))
    return down.filter(F.size("failed") > 0).select("outlet", text.alias("error"))


def audit_groups(audit: DataFrame) -> DataFrame:
    """One row per group of a feed audit: usable feeds, outlets that need a page reader, and usable ones without dates.

    An outlet is usable where one of its feeds has a usable entry. Names are joined in order (outlets are configured by hand).
    """
    o = audit.groupBy("outlet").agg((F.sum("usable") > 0).alias("rss"), (F.sum("with_dates") > 0).alias("dated"))
    o = o.select("outlet", F.explode(F.filter(F.array(F.when(F.col("rss"), "rss").otherwise("html"), F.when(F.col("rss") & ~F.col("dated"), "nodates")), lambda g: g.isNotNull())).alias("group"))
    return o.groupBy("group").agg(F.count("*").alias("outlets"), F.array_join(F.sort_array(F.collect_list("outlet")), ",").alias("names"))


def stale_feeds(entries: DataFrame, as_of, days: int = 4, keys: tuple[str, ...] = ("outlet", "feed_pos")) -> DataFrame:
    """Newest publish time of each feed and whether it is stale. A warning only: rows stay."""
    newest = entries.groupBy(*keys).agg(F.max("published_at").alias("newest"))
    return newest.withColumn("stale", F.coalesce(F.col("newest") < as_of - F.make_dt_interval(days=F.lit(days)), F.lit(False)))


def longest_title(links: DataFrame) -> DataFrame:
    """One row per (outlet, url): the longest title, the earlier on ties.

    Its own date counts; where it has none, the date of the nearest earlier row that held the lead is carried on.
    A shorter later row's date is lost. Needs outlet, url, pos, title, published_at.
    """
    w = W.partitionBy("outlet", "url").orderBy("pos")
    before = F.coalesce(F.max(F.length("title")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    leads = links.withColumn("_before", before).filter(F.length("title") > F.col("_before"))
    return leads.groupBy("outlet", "url").agg(
        F.max_by("title", "pos").alias("title"), F.max_by("published_at", F.when(F.col("published_at").isNotNull(), F.col("pos"))).alias("published_at")
    )


def pattern_stubs(pages: DataFrame, listing_url: str, pattern: str, title_datetime_pattern: str | None = None, strip_trailing_time: bool = False) -> DataFrame:
    """Stubs of listing pages by the shape of article links; rows without a title are dropped."""
    a = pages.select("outlet", F.explode(H.extract_anchors("html")).alias("a")).select("outlet", "a.*").filter(F.col("href").rlike(pattern))
    title, at = F.col("title"), F.lit(None).cast("timestamp")
    if title_datetime_pattern:
        title, at = split_datetime_prefix(title, title_datetime_pattern)
    if strip_trailing_time:
        title = strip_trailing_clock(title)
    rows = a.select("outlet", resolve(listing_url, F.col("href")).alias("url"), "pos", title.alias("title"), at.alias("published_at"))
    return longest_title(rows).filter(F.col("title") != "").select("outlet", F.col("url").alias("url_original"), "title", "published_at")


def island_stubs(pages: DataFrame, listing_url: str) -> DataFrame:
    """Stubs from component props, with ``error`` rows for pages whose component is missing."""
    got = pages.select("outlet", H.extract_island("html").alias("i")).select("outlet", "i.error", F.explode_outer("i.rows").alias("r"))
    return got.filter(F.col("r").isNotNull() | F.col("error").isNotNull()).select(
        "outlet", resolve(listing_url, F.col("r.href")).alias("url_original"), "r.title", epoch(F.col("r.epoch")).alias("published_at"), "error"
    )


def stubs_for(outlet: dict, documents: DataFrame) -> DataFrame:
    """Reader by the outlet's parser; ``documents`` holds that outlet's feeds or pages."""
    kind = outlet["parser"]
    if kind == "rss":
        return feed_stubs(documents)
    if kind == "pattern":
        if not outlet.get("listing_url") or not outlet.get("article_url_pattern"):
            raise ValueError(f"{outlet['code']}: a pattern listing needs listing_url and article_url_pattern")
        return pattern_stubs(documents, outlet["listing_url"], outlet["article_url_pattern"], outlet.get("title_datetime_pattern"), outlet.get("strip_trailing_time", False))
    if kind == "tvbs":
        return island_stubs(documents, outlet["listing_url"]).drop("error")
    raise ValueError(f"{outlet['code']}: unknown parser {kind!r}")
