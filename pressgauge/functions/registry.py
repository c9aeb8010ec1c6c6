"""Functions by name for SQL: ``register(spark)`` makes the engine's row functions callable in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import html
from .text import segment_udf


def register(spark: SparkSession, terms: tuple[str, ...] = ()) -> list[str]:
    """Register the Arrow functions (page readers, lenient dates, segmentation with the given dictionary); returns their names.

    URL keys, tokens and the other dates are native column expressions of this package and need no registration.
    """
    named = {
        "article_body": html.extract_body, "article_times": html.published_candidates, "page_anchors": html.extract_anchors,
        "island_rows": html.extract_island, "lenient_date": html.lenient_date, "segment_text": segment_udf(terms),
    }
    for name, f in named.items():
        spark.udf.register(name, f)
    return sorted(named)
