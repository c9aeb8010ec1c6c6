"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Every stage takes all rows that the one before kept; its result is written as Parquet and read again. All but the last
return the columns of documents. Null and empty texts are clean, so they reach packing, where each is one end token.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm import bpe, decontaminate, minhash, packing, pii, toxicity
from pressgauge.llm.common import saved, table


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__toxicity").filter(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return minhash.deduplicate(docs)


def benchmark_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(docs, lambda: bpe.encoder(ranks))


STAGES = [
    ("toxicity", toxic_documents_out), ("near_duplicates", one_of_each_group), ("decontamination", benchmark_passages_out),
    ("personal_data", personal_data_redacted), ("packing", packed),
]

# A trained model, sampled signatures, alignment and byte-pair merges are not SQL; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every earlier stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
