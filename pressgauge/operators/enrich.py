"""Tier 2: page text and publish time of selected articles, one outcome row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import read_article
from ..functions.text import segment_udf
from ..functions.times import first_acceptable
from ..functions.urls import cache_path
from ..sources.pagestore import cache_first
from . import merge
from .search import search

MIN_BODY = 80


def offsets(pages: DataFrame, outlets: DataFrame) -> DataFrame:
    """The outlet's offset flag, false where the outlet is unknown (the dimension is a hand-written file)."""
    dim = outlets.select(F.col("code").alias("outlet"), "timestamp_offset_is_wrong").dropDuplicates(["outlet"])
    return pages.join(dim, "outlet", "left").fillna({"timestamp_offset_is_wrong": False})


def enrich(pages: DataFrame) -> DataFrame:
    """pages(id, html, from_cache, seen_at, published_at, timestamp_offset_is_wrong) with body, recovered_at, state and error.

    A page is parsed once. A body under 80 characters is a failure; nothing raises.
    """
    read = pages.withColumn("_read", read_article("html"))
    read = read.withColumn("body", F.when(F.col("html").isNotNull(), F.col("_read.body"))).withColumn("_times", F.col("_read.times"))
    n = F.length(F.coalesce("body", F.lit("")))
    error = F.when(F.col("html").isNull(), F.lit("page not available")).when(n < MIN_BODY, F.concat(F.lit("body too short: "), n.cast("string"), F.lit(" chars")))
    at = first_acceptable(F.col("_times"), F.col("seen_at"), F.col("timestamp_offset_is_wrong"))
    out = read.withColumn("error", error).withColumn("state", F.when(error.isNull(), "fetched").otherwise("failed"))
    out = out.withColumn("recovered_at", F.when(error.isNull(), at)).drop("_times", "_read")
    return out.withColumn("backfills", F.col("published_at").isNull() & F.col("recovered_at").isNotNull())


def counters(outcomes: DataFrame) -> DataFrame:
    """One row: matched, fetched, cached, dated, failed. A page counts as fetched or cached before its body is judged."""
    got = F.col("html").isNotNull()
    return outcomes.agg(
        F.count("*").alias("matched"), F.count_if(got & ~F.col("from_cache")).alias("fetched"), F.count_if(got & F.col("from_cache")).alias("cached"),
        F.count_if("backfills").alias("dated"), F.count_if(F.col("state") == "failed").alias("failed"),
    )


def enrich_keyword(
    index: DataFrame, articles: DataFrame, cache: DataFrame, fetched: DataFrame, outlets: DataFrame, keyword: str,
    limit: int = 200, refetch: bool = False, terms: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Tier 2 as one plan: search, cached page first, extract, save, backfill and mark failures, a row's failure its own.

    ``cache`` and ``fetched`` hold (path, html) by ``cache_path``; fetching itself is outside the engine. Returns the frames
    ``outcomes`` (one row per matched article), ``counters`` (one row), and the new ``articles`` and ``index`` tables. Text of
    an earlier success stays when a later run fails.
    """
    wanted = search(index, keyword, limit, terms=terms).withColumn("path", cache_path(F.col("outlet"), F.col("url_canonical"), F.col("seen_at")))
    pages = offsets(cache_first(wanted, cache, fetched, refetch), outlets)
    outcomes = enrich(pages).withColumn("body_seg", segment_udf(terms)("body"))
    good, bad = outcomes.filter("state = 'fetched'"), outcomes.filter("state = 'failed'")
    saved = merge.save_enriched(articles, good.select("id", "body", "body_seg", F.col("path").alias("raw_html_path")))
    dated = merge.backfill_published(index, good.filter("backfills").select("id", F.col("recovered_at").alias("published_at")))
    return {
        "outcomes": outcomes, "counters": counters(outcomes), "articles": merge.mark_failed(saved, bad.select("id", "error")),
        "index": merge.flag_fetched(dated, good.select("id")),
    }
