"""Keyword search over segmented titles or bodies, and re-segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_all, query_tokens, segment_udf, term_score, tokens
from ..functions.times import effective_at


def search(index: DataFrame, keyword: str, limit: int = 200, column: str = "title_seg", terms: tuple[str, ...] = ()) -> DataFrame:
    """Rows holding every token of ``keyword``, newest first (ties by id). The score is reported, not the sort key.

    A blank keyword gives no rows. The limit is the feature: sort and limit run as one top-k operator.
    """
    wanted = query_tokens(keyword, terms)
    toks = tokens(F.col(column))
    at = effective_at(F.col("published_at"), F.col("seen_at"))
    hit = index.filter(matches_all(toks, wanted)) if wanted else index.filter(F.lit(False))
    return hit.withColumn("effective_at", at).withColumn("rank", term_score(toks, wanted)).orderBy(F.desc("effective_at"), "id").limit(limit)


def inverted_index(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(token, key) postings, one per distinct token of a row: write bucketed by token for repeated lookups."""
    return docs.select(key, F.explode(F.array_distinct(tokens(F.col(column)))).alias("token"))


def resegment(table: DataFrame, source: str, target: str, terms: tuple[str, ...] = (), order_by: str | None = None) -> DataFrame:
    """Recompute a token column over the whole table; rows with no text keep what they have. ``order_by`` sorts the result."""
    has = F.col(source).isNotNull() & (F.col(source) != "")
    fresh = segment_udf(terms)(F.col(source))
    out = table.withColumn(target, F.when(has, fresh).otherwise(F.col(target)) if target in table.columns else F.when(has, fresh))
    return out if order_by is None else out.orderBy(order_by)
