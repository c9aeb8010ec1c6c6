"""Explicit schemas of the engine's tables; ``evolve`` is the migration step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _B, _TS, _D, _F = (
    T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DateType(), T.FloatType(),
)


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) < 3) for f in fields])


OUTLETS = _table(("code", _S, 1), ("name_zh", _S, 1), ("home_url", _S, 1), ("active", _B, 1))
STUBS = _table(("outlet", _S, 1), ("url_original", _S, 1), ("title", _S, 1), ("published_at", _TS))
ARTICLE_INDEX = _table(
    ("id", _L, 1), ("outlet", _S, 1), ("url_canonical", _S, 1), ("url_original", _S, 1), ("title", _S, 1),
    ("title_seg", _S), ("published_at", _TS), ("seen_at", _TS, 1), ("body_fetched", _B, 1),
)
ARTICLES = _table(
    ("id", _L, 1), ("body", _S), ("body_seg", _S), ("raw_html_path", _S), ("enrich_state", _S, 1), ("enrich_error", _S),
    ("simhash", _L), ("band0", _I), ("band1", _I), ("band2", _I), ("band3", _I), ("dup_cluster_id", _L),
    ("is_cluster_origin", _B), ("cluster_rank", _I), ("delta_added", T.ArrayType(_S)), ("delta_removed", T.ArrayType(_S)),
    ("delta_summary", _S), ("stance_label", _S), ("stance_score", _F), ("stance_model", _S), ("aspect_label", _S), ("updated_at", _TS),
)
DUP_CLUSTERS = _table(
    ("cluster_id", _L, 1), ("member_count", _I, 1), ("shared_core_text", _S), ("origin_article_id", _L),
    ("first_published_at", _TS), ("origin_confident", _B), ("computed_at", _TS),
)
OUTLET_DAILY_TOTALS = _table(("outlet", _S, 1), ("day", _D, 1), ("total_articles", _I, 1), ("complete", _B, 1), ("computed_at", _TS))
CRAWL_RUNS = _table(
    ("run_id", _L), ("outlet", _S, 1), ("started_at", _TS, 1), ("finished_at", _TS), ("items_seen", _I), ("items_new", _I),
    ("ok", _B, 1), ("error", _S),
)
SOCIAL_POSTS = _table(
    ("id", _L), ("platform", _S, 1), ("board", _S), ("post_url", _S, 1), ("posted_at", _TS), ("seen_at", _TS), ("text", _S),
    ("text_seg", _S), ("stance_label", _S), ("stance_score", _F), ("aspect_label", _S),
)
TABLES = {
    "outlets": OUTLETS, "article_index": ARTICLE_INDEX, "articles": ARTICLES, "dup_clusters": DUP_CLUSTERS,
    "outlet_daily_totals": OUTLET_DAILY_TOTALS, "crawl_runs": CRAWL_RUNS, "social_posts": SOCIAL_POSTS,
}
ENRICH_STATES = ("pending", "fetched", "enriched", "failed")
STANCES = ("neg", "neu", "pos")


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order; missing ones become typed nulls. Running it twice changes nothing."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def violations(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no parent (a data-quality check; Spark enforces none)."""
    return df.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").filter(F.col(key).isNotNull())


#: Ordered steps of the stored tables: (name, table, SQL value of each column that a row lacks).
MIGRATIONS = (("001_daily_totals_completeness", "outlet_daily_totals", {"complete": "false", "computed_at": "cast(null as timestamp)"}),)


def migrate(table: str, df: DataFrame, done: set[str] = frozenset()) -> tuple[DataFrame, list[str]]:
    """``df`` after the steps of ``table`` that are not in ``done``, in order of their names, and those names.

    A column that is there already stays, so a step that ran before changes nothing; ``evolve`` to the schema comes last.
    """
    ran = []
    for name, of, adds in sorted(MIGRATIONS, key=lambda m: m[0]):
        if of == table and name not in done:
            df = df.withColumns({c: F.expr(v) for c, v in adds.items() if c not in df.columns})
            ran.append(name)
    return evolve(df, TABLES[table]), ran
