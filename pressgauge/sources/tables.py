"""Parquet tables of a data folder, and the stand-ins for the engine's own tables on the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl-run log: one run per event, the event type as outlet, ``value >= 5`` as success."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("outlet"), F.col("ts").alias("started_at"), (F.col("value") >= 5).alias("ok"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article index: every third event has no publisher time, every seventh claims a future one."""
    e = table(spark, sf_dir, "events")
    shift = F.when(F.col("event_id") % 7 == 0, F.lit(180)).otherwise(-(F.col("event_id") % 240).cast("int"))
    published = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("ts") + F.make_dt_interval(mins=shift))
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("outlet"), published.alias("published_at"), F.col("ts").alias("seen_at"))
