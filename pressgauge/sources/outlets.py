"""The outlet dimension from a YAML file (bounded by hand-written configuration, so it may be broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARSERS = ("rss", "pattern", "tvbs")
_SCHEMA = (
    "code string, name_zh string, home_url string, parser string, verified boolean, has_dates boolean, feed_urls array<string>, "
    "listing_url string, article_url_pattern string, title_datetime_pattern string, strip_trailing_time boolean, "
    "timestamp_offset_is_wrong boolean, rate_limit_seconds double, user_agent string, timeout_seconds double"
)


def read_outlets(path: str) -> list[dict]:
    """Outlet rows with defaults applied; ``feed_url`` is a list of one."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading outlet files needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    defaults = {"rate_limit_seconds": 2.0, "timeout_seconds": 20, "user_agent": ""} | (raw.get("defaults") or {})
    out = []
    for o in raw.get("outlets") or []:
        row = defaults | o
        feeds = row.get("feed_urls") or ([row["feed_url"]] if row.get("feed_url") else [])
        out.append(
            {k: row.get(k) for k in ("code", "name_zh", "home_url", "listing_url", "article_url_pattern", "title_datetime_pattern")}
            | {k: bool(row.get(k, False)) for k in ("verified", "has_dates", "strip_trailing_time", "timestamp_offset_is_wrong")}
            | {"parser": row.get("parser", "rss"), "feed_urls": feeds, "user_agent": row["user_agent"]}
            | {k: float(row[k]) for k in ("rate_limit_seconds", "timeout_seconds")}
        )
    return out


def outlets_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [x.strip().split()[0] for x in _SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], _SCHEMA)


def select_outlets(rows: list[dict], only: list[str] | None = None) -> list[dict]:
    """Verified outlets, or the named ones; a name that is unknown or unverified is an error."""
    if not only:
        return [r for r in rows if r["verified"]]
    by = {r["code"]: r for r in rows}
    if bad := [c for c in only if c not in by or not by[c]["verified"]]:
        raise ValueError(f"unknown or unverified outlets: {', '.join(bad)}")
    return [by[c] for c in only]
