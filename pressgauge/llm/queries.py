"""The llm queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, lm, minhash, packing, pii, suffix, toxicity, warc
from .common import new_path, table


def op1_decontamination(spark, d):
    return decontaminate.contaminations(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_chat_formatting(spark, d):
    says = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.windows(turns))


def op3_pii(spark, d):
    s = pii.spans(table(spark, d, "documents").select("doc_id", "text"))

    def count(k):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [count(k) for k in pii.KINDS]
    return s.select("doc_id", *counts[:4], F.sha2(pii.joined("spans", pii.BASE), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), *counts[4:], pii.scores("spans").alias("scores"))


def op4_ann(spark, d):
    v = table(spark, d, "embeddings")
    return ann.search(v, v.filter(F.col("vec_id") % 100 == 0))


def op5_warc(spark, d):
    got = warc.captures(table(spark, d, "pages"), new_path(spark, "warc"))
    c = F.col("capture")
    return got.select(
        F.col("metadata.page_id").alias("page_id"), c["payload_bytes"].alias("payload_bytes"), c["payload_digest"].alias("payload_digest"),
        c["record_type"].alias("record_type"), c["refers_to"].alias("refers_to"), F.col("request.target_uri").alias("target_uri"),
    )


def op6_packing(spark, d):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json as ranks
    return packing.pack(table(spark, d, "documents"), lambda: bpe.encoder(ranks))


def op7_suffix_dedup(spark, d):
    return suffix.remove_repeats(table(spark, d, "documents"))


def op8_toxicity(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.train(docs, table(spark, d, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_minhash(spark, d):
    return minhash.classes(table(spark, d, "documents"))


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def op10_lm_scoring(spark, d):
    corpus = lm.encode(table(spark, d, "documents"))
    return lm.score_on(corpus, lm.train_on(corpus))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_chat_formatting, op3_pii, op4_ann, op5_warc, op6_packing, op7_suffix_dedup, op8_toxicity, op9_minhash, op10_lm_scoring, pipeline)}
# The others are tested against brute force, round trips or held-out accuracy: a model, an alignment, a tokenizer or a template is not SQL.
ORACLES: dict[str, str] = {
    "op5_warc": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
      f AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
      SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to, url AS target_uri FROM f""",
}
