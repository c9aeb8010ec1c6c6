from pyspark.sql import functions as F

from pressgauge.streaming.crawl import ingest, streaming_daily_totals


def test_first_sight_wins_across_batches(spark, tmp_path):
    src, table, runs = (str(tmp_path / n) for n in ("src", "table", "runs"))
    schema = "outlet string, url_original string, title string, published_at timestamp, seen_at timestamp"
    rows = [[("o", "https://www.x.com/1?utm_a=1", "a", None, None), ("o", "https://x.com/1", "b", None, None)], [("o", "http://x.com/1/", "c", None, None), ("o", "https://x.com/2", "d", None, None)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).withColumn("seen_at", F.timestamp_seconds(F.lit(i))).coalesce(1).write.mode("append").parquet(src)
        q = ingest(spark.readStream.schema(schema).parquet(src), table, runs, str(tmp_path / "ckpt"))
        q.awaitTermination(90)
    got = sorted(r.url_canonical for r in spark.read.parquet(table).collect())
    assert got == ["https://x.com/1", "https://x.com/2"]
    assert sorted((r.items_seen, r.items_new) for r in spark.read.parquet(runs).collect()) == [(2, 1), (2, 1)]
    totals = streaming_daily_totals(spark.readStream.schema(schema).parquet(src))
    q = totals.writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r.total_articles for r in spark.table("totals").collect()] == [4]


def test_a_batch_that_runs_again_replaces_itself_and_failures_stay_apart(spark, tmp_path):
    import shutil

    src, table, runs, ckpt = (str(tmp_path / n) for n in ("src", "table", "runs", "ckpt"))
    schema = "outlet string, url_original string, title string, published_at timestamp, seen_at timestamp, error string"
    rows = [("o", "https://x.com/1", "早報 a", None, None, None), ("o", None, None, None, None, "feed 2: timeout"), ("p", None, None, None, None, "down")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    seen = []
    for _ in range(2):
        shutil.rmtree(ckpt, ignore_errors=True)  # the second run starts again with batch 0
        ingest(spark.readStream.schema(schema).parquet(src), table, runs, ckpt, terms=("早報",)).awaitTermination(90)
        seen.append(sorted(map(tuple, spark.read.parquet(table).select("id", "url_canonical", "title_seg").collect())))
    assert seen[0] == seen[1] and seen[0][0][1:] == ("https://x.com/1", "早報 a")
    log = {r.outlet: (r.items_seen, r.items_new, r.ok, r.error) for r in spark.read.parquet(runs).collect()}
    assert log == {"o": (1, 1, False, "feed 2: timeout"), "p": (0, 0, False, "down")}
