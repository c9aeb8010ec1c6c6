import corpus_pipeline
from pyspark.sql import functions as F

from pressgauge.llm import decontaminate as D
from pressgauge.llm import minhash as M


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.lit(None).cast("string"))
    docs = docs.unionByName(odd)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.count(), docs.count())
        if name == "near_duplicates":
            classes = M.classes(before)
            assert {r.doc_id for r in docs.collect()} == {r.class_id for r in classes.collect()}
        if name == "decontamination":
            bad = {r.doc_id for r in D.contaminations(before, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
        if name == "personal_data":
            assert docs.count() == before.count() and not docs.filter(F.col("text").rlike("[a-z]@[a-z]+[.][a-z]")).count()
            last = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in docs.collect()} == last
    assert docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).filter("n <> m").count() == 0
    assert kept["toxicity"][1] > 0.8 * kept["toxicity"][0]


def test_odd_tables_pass_every_stage(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, columns named like the stages' own, and no rows at all."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(40)
    for name in ("score", "node", "class_id", "part", "spans", "text_key"):
        docs = docs.withColumn(name, F.lit("x"))
    null = docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    blank = docs.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit(""))
    for table, n in ((docs.unionByName(null).unionByName(blank).unionByName(blank), 20), (docs.limit(0), 0)):
        table.write.parquet(str(tmp_path / f"in{n}"))
        now = spark.read.parquet(str(tmp_path / f"in{n}"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, d)
            assert out.columns == table.columns, name
            out.write.parquet(str(tmp_path / f"{name}{n}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{n}"))
            assert now.count() >= n and (n == 0 or now.filter("doc_id is null").count() == now.filter("doc_id = -1").count() == 1 or name == "toxicity"), name
        last = corpus_pipeline.STAGES[-1][1](spark, now, d)
        assert last.select(F.coalesce("doc_id", F.lit(-9))).distinct().count() == now.select(F.coalesce("doc_id", F.lit(-9))).distinct().count()
