"""Tier 1: a batch of listing rows into the article index, with a run-log row per outlet and partial failures kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import segment_udf
from ..functions.urls import canonicalize
from .merge import insert_if_absent, run_log

KEYS = ["outlet", "url_canonical"]


def ingest(stubs: DataFrame, target: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """Rows to append: first sight of each (outlet, url_canonical), with id, canonical key and segmented title.

    The id is a hash of the key, so a batch that runs again gives the same rows. The table is reduced to the batch's keys
    first: a small batch travels to the table by broadcast (as its measured size allows), and the table is not shuffled.
    """
    rows = stubs.withColumn("url_canonical", canonicalize(F.col("url_original"))).filter(F.col("url_canonical").isNotNull() & F.col("outlet").isNotNull())
    known = target.select(*KEYS).join(rows.select(*KEYS).distinct(), KEYS, "left_semi")
    new = insert_if_absent(known, rows, KEYS, ["seen_at", "url_original"])
    return new.select(
        F.xxhash64(*KEYS).alias("id"), *KEYS, "url_original", "title", segment_udf(terms)("title").alias("title_seg"), "published_at", "seen_at",
        F.lit(False).alias("body_fetched"),
    )


def log(outlets: DataFrame, stubs: DataFrame, new: DataFrame, failures: DataFrame) -> DataFrame:
    """outlets(outlet) with items_seen, items_new, ok and error. What arrived from an outlet whose source failed in part is
    kept and counted, and its run is not ok; an outlet without rows is not ok either."""
    seen = stubs.groupBy("outlet").agg(F.count("*").alias("items_seen"))
    added = new.groupBy("outlet").agg(F.count("*").alias("items_new"))
    errors = failures.groupBy("outlet").agg(F.min("error").alias("error"))
    j = outlets.select("outlet").distinct().join(seen, "outlet", "left").join(added, "outlet", "left").join(errors, "outlet", "left")
    return run_log(j.fillna(0, ["items_seen", "items_new"]))


def outcome(runs: DataFrame) -> DataFrame:
    """One row: names of failed outlets, of outlets that were fine but empty, and the exit code. Outlets are configured by hand."""
    names = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("outlet")))), ",")
    return runs.agg(names(~F.col("ok")).alias("failed"), names(F.col("ok") & (F.col("items_seen") == 0)).alias("empty"), F.when(F.count_if(~F.col("ok")) > 0, 1).otherwise(0).alias("exit_code"))
