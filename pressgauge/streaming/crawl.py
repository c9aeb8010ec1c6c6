"""Listing ingestion as Structured Streaming: each micro-batch is deduplicated against the table and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import crawl as tier1

_NEW = "id long, outlet string, url_canonical string, url_original string, title string, title_seg string, published_at timestamp, seen_at timestamp, body_fetched boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingest(stubs: DataFrame, table_path: str, runs_path: str, checkpoint: str, available_now: bool = True, interval: str = "20 minutes", terms: tuple[str, ...] = ()) -> StreamingQuery:
    """stubs(outlet, url_original, title, published_at, seen_at[, error]) into the index, first sight wins, with a run-log row
    per outlet. A row with an ``error`` stands for a source that failed: the rest is kept and the outlet's run is not ok.

    The horizon of the deduplication is unbounded and exact: an anti join against the table, not a watermark. Both sinks
    are partitioned by batch_id and overwritten dynamically, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch if "error" in batch.columns else batch.withColumn("error", F.lit(None).cast("string"))
        rows, failed = batch.filter("error is null").drop("error"), batch.filter("error is not null").select("outlet", "error")
        schema = f"{_NEW}, batch_id bigint"
        old = spark.read.schema(schema).parquet(table_path).filter(F.col("batch_id") != batch_id) if _exists(spark, table_path) else spark.createDataFrame([], schema)
        put = {"partitionOverwriteMode": "dynamic"}
        tier1.ingest(rows, old, terms).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").options(**put).partitionBy("batch_id").parquet(table_path)
        written = spark.read.schema(schema).parquet(table_path).filter(F.col("batch_id") == batch_id)
        log = tier1.log(batch.select("outlet"), rows, written, failed)
        log.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").options(**put).partitionBy("batch_id").parquet(runs_path)

    w = stubs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def streaming_daily_totals(index: DataFrame, delay: str = "7 days", tz_offset: str = "16 hours") -> DataFrame:
    """Totals per outlet and local day on a stream, day windows starting at local midnight, late rows accepted for ``delay``."""
    at = F.least(F.coalesce("published_at", "seen_at"), F.col("seen_at")).cast("timestamp")
    day = F.window("effective_at", "1 day", "1 day", tz_offset)
    return index.withColumn("effective_at", at).withWatermark("effective_at", delay).groupBy("outlet", day.alias("day_window")).agg(F.count("*").alias("total_articles"))
