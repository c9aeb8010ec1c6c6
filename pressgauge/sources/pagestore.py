"""Stored pages: gzip members under ``outlet/day/sha256.html.gz`` or a Parquet store partitioned the same way."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import cache_path


def _inflate(data: bytes | None) -> str | None:
    try:
        return gzip.decompress(data).decode("utf-8") if data is not None else None
    except (OSError, EOFError, ValueError, zlib.error):
        return None


@F.pandas_udf(T.StringType())
def gunzip(data: pd.Series) -> pd.Series:
    return data.map(_inflate)


@F.pandas_udf(T.BinaryType())
def gzip_bytes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: gzip.compress(t.encode("utf-8"), mtime=0), na_action="ignore")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """path (relative) and html of stored gzip pages; a damaged file is a miss (NULL), not an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html.gz").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+\.html\.gz)$", 1).alias("path"), gunzip("content").alias("html"))


def _decoder(charset: str):
    @F.pandas_udf(T.StringType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: bytes(x).decode(charset, "replace"), na_action="ignore")

    return run


def decoded(files: DataFrame, charset: str = "UTF-8", fallback: str = "GBK") -> DataFrame:
    """Bytes as text; where the declared charset is absent or Latin-1, UTF-8 if it is valid, else ``fallback``.

    The JVM functions know only a few charsets, so the others are decoded by an Arrow UDF; bad bytes become U+FFFD.
    """
    if charset.lower() not in ("", "iso-8859-1", "utf-8"):
        return files.withColumn("text", _decoder(charset)("content"))
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    other = _decoder(fallback)(F.when(~utf8, F.col("content")))  # nothing is sent where UTF-8 is valid
    return files.withColumn("text", F.when(utf8, F.col("content").cast("string")).otherwise(other))


def write_pages(pages: DataFrame, root: str) -> None:
    """Append pages(outlet, url_canonical, seen_at, html) to the Parquet store; the commit protocol renames atomically."""
    keyed = pages.withColumn("path", cache_path(F.col("outlet"), F.col("url_canonical"), F.col("seen_at")))
    keyed.select("outlet", F.date_format("seen_at", "yyyy-MM-dd").alias("seen_date"), "path", gzip_bytes("html").alias("content")).write.mode("append").partitionBy(
        "outlet", "seen_date"
    ).parquet(root)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """path and html of the Parquet store; of equal paths any copy serves."""
    return spark.read.parquet(root).groupBy("path").agg(F.any_value("content").alias("content")).select("path", gunzip("content").alias("html"))


def cache_first(wanted: DataFrame, cache: DataFrame, fetched: DataFrame, refetch: bool = False) -> DataFrame:
    """wanted(path, ...) with html and from_cache: the stored page unless ``refetch``, else the fetched one."""
    c = cache.select("path", F.col("html").alias("_cached"))
    f = fetched.select("path", F.col("html").alias("_fetched"))
    hit = F.lit(False) if refetch else F.col("_cached").isNotNull()
    out = wanted.join(c, "path", "left").join(f, "path", "left")
    return out.withColumn("from_cache", hit).withColumn("html", F.when(hit, F.col("_cached")).otherwise(F.col("_fetched"))).drop("_cached", "_fetched")
