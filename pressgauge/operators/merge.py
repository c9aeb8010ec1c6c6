"""Keyed writes as pure functions: (target, updates) -> new table. Plain Parquet has no MERGE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_error


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key by ``order``, where the target has no such key."""
    from ..sources.listings import keep_first

    return keep_first(batch, keys, order).join(target.select(*keys), keys, "left_anti")


def seen_and_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """items_seen, items_new (rows that would be added) and items_distinct (a dry run's count) of a batch."""
    fresh = batch.select(*keys).distinct().join(target.select(*keys), keys, "left_anti")
    seen = batch.agg(F.count("*").alias("items_seen"), F.count_distinct(*keys).alias("items_distinct"))
    return seen.crossJoin(fresh.agg(F.count("*").alias("items_new")))  # one row each


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], policy: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Full-outer keyed merge. ``policy[col](old, new)`` decides where both sides hold the key; default: the update wins.

    Columns that the update lacks keep the old value. One shuffle per side, none where both are bucketed by the key.
    """
    policy = policy or {}
    t = target.withColumn("_old", F.lit(True))
    u = updates.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c not in keys])
    j = t.join(u, keys, "full_outer")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        old = F.col(c)
        if c not in updates.columns:
            return old
        new = F.col(f"_u_{c}")
        return F.when(both, policy.get(c, lambda o, n: n)(old, new)).when(F.col("_new").isNotNull(), new).otherwise(old).alias(c)

    return j.select(*[value(c) for c in target.columns])


def keep_old(old: Column, new: Column) -> Column:
    return old


def fill_missing(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def backfill_published(index: DataFrame, recovered: DataFrame, key: str = "id") -> DataFrame:
    """A recovered time fills a missing one and never replaces a listing's."""
    return upsert(index, recovered.join(index.select(key), key, "left_semi"), [key], {"published_at": fill_missing})


def save_enriched(articles: DataFrame, rows: DataFrame) -> DataFrame:
    """Re-runs overwrite the row, set state ``fetched`` and clear the error."""
    full = rows.withColumn("enrich_state", F.lit("fetched")).withColumn("enrich_error", F.lit(None).cast("string"))
    return upsert(articles, full, ["id"])


def flag_fetched(index: DataFrame, enriched: DataFrame) -> DataFrame:
    """``body_fetched`` is true for every id in ``enriched`` and unchanged elsewhere."""
    hit = enriched.select("id").distinct().withColumn("_hit", F.lit(True))
    return index.join(hit, "id", "left").withColumn("body_fetched", F.col("_hit").isNotNull() | F.col("body_fetched")).select(*index.columns)


def mark_failed(articles: DataFrame, failures: DataFrame) -> DataFrame:
    """failures(id, error): state and error change (at most 2000 characters), the stored body stays."""
    f = failures.select("id", F.lit("failed").alias("enrich_state"), truncate_error(F.col("error")).alias("enrich_error"))
    return upsert(articles, f, ["id"])


def refresh_outlets(target: DataFrame, config: DataFrame) -> DataFrame:
    """Names and URLs follow the configuration; ``active`` is the operator's and stays (true when new)."""
    return upsert(target, config.select("code", "name_zh", "home_url", F.lit(True).alias("active")), ["code"], {"active": keep_old})


def run_log(batches: DataFrame) -> DataFrame:
    """Judge crawl batches(outlet, items_seen, items_new, error): ok means rows seen and no error; none seen is an error text."""
    seen = F.coalesce(F.col("items_seen"), F.lit(0))
    error = F.coalesce(F.col("error"), F.when(seen == 0, F.lit("0 items seen")))
    return batches.withColumn("error", truncate_error(error)).withColumn("ok", (seen > 0) & error.isNull())
