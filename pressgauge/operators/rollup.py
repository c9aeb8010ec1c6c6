"""Daily totals with a completeness flag, their summary, and the crawl-health report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import effective_at, local_day, local_time
from ..session import LOCAL_TZ

#: Gap charged to a day whose only run is an outlet's first ever.
NO_PREVIOUS_RUN_S = 99 * 3600


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a ``timestamp_ntz`` wall clock (the session runs in UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def daily_totals(index: DataFrame, since: Column | None = None, tz: str = LOCAL_TZ) -> DataFrame:
    """Articles per outlet and local day of ``effective_at``; ``since`` bounds a trailing recompute.

    Pass a local midnight as ``since``: a bound in mid-day recounts that day in part and overwrites a full total.
    """
    at = effective_at(F.col("published_at"), F.col("seen_at"))
    rows = index.select("outlet", at.alias("effective_at"))
    if since is not None:
        rows = rows.filter(F.col("effective_at") >= since)
    return rows.groupBy("outlet", local_day(F.col("effective_at"), tz).alias("day")).agg(F.count("*").alias("total_articles"))


def day_coverage(runs: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """First and last good run and the widest gap per outlet and local day.

    A gap over midnight is charged to the day of the run that ends it. Gaps within a day come from a window over that day
    alone; the gap into a day is its first run less the last run of the outlet's day before, found on one row a day, so the
    runs of a busy outlet never meet in one task.
    """
    ok = runs.filter("ok").select("outlet", "started_at", "run_id")
    local = local_time(F.col("started_at"), tz)
    r = ok.select("outlet", local.alias("ts"), local.cast("date").alias("day"), micros(F.col("started_at")).alias("us"), "run_id")
    within = F.col("us") - F.lag("us").over(W.partitionBy("outlet", "day").orderBy("us", "run_id"))
    d = r.withColumn("gap", within).groupBy("outlet", "day").agg(
        F.min("ts").alias("first_run"), F.max("ts").alias("last_run"), F.max("gap").alias("gap"), F.min("us").alias("from"), F.max("us").alias("to")
    )
    into = F.col("from") - F.lag("to").over(W.partitionBy("outlet").orderBy("from"))
    widest = F.coalesce(F.greatest("gap", into), F.lit(NO_PREVIOUS_RUN_S * 1_000_000))
    return d.select("outlet", "day", "first_run", "last_run", widest.alias("max_gap_us"))


def completeness(totals: DataFrame, coverage: DataFrame, today: Column, max_gap_minutes: int = 90) -> DataFrame:
    """Totals with ``complete``: the day is over and good runs bracket it with no wide gap. Never NULL."""
    gap, start = max_gap_minutes * 60_000_000, micros(F.col("day").cast("timestamp_ntz"))
    complete = (
        (F.col("day") < today)
        & (micros(F.col("first_run")) <= start + gap)
        & (micros(F.col("last_run")) >= start + 86_400_000_000 - gap)
        & (F.col("max_gap_us") <= gap)
    )
    j = totals.join(coverage, ["outlet", "day"], "left")
    return j.select("outlet", "day", "total_articles", F.coalesce(complete, F.lit(False)).alias("complete"))


def rollup(index: DataFrame, runs: DataFrame, today: Column, since: Column | None = None, max_gap_minutes: int = 90, tz: str = LOCAL_TZ) -> DataFrame:
    return completeness(daily_totals(index, since, tz), day_coverage(runs, tz), today, max_gap_minutes)


def completeness_summary(totals: DataFrame) -> DataFrame:
    return totals.agg(F.count_if("complete").alias("complete_days"), F.count_if(~F.col("complete")).alias("incomplete_days"))


def crawl_health(runs: DataFrame, as_of: Column, hours: int = 24, tz: str = LOCAL_TZ) -> DataFrame:
    """Last good run, good runs and widest gap (0 if none) per outlet over the last hours, widest first."""
    recent = runs.filter(F.col("ok") & (F.col("started_at") > as_of - F.make_dt_interval(hours=F.lit(hours))))
    w = W.partitionBy("outlet").orderBy("started_at", "run_id")
    gap = micros(F.col("started_at")) - micros(F.lag("started_at").over(w))
    out = recent.select("outlet", "started_at", gap.alias("gap")).groupBy("outlet").agg(
        F.date_format(local_time(F.max("started_at"), tz), "MM-dd HH:mm").alias("last_ok"),
        F.count("*").alias("ok_runs"),
        F.floor(F.coalesce(F.max("gap"), F.lit(0)) / 1_000_000).alias("largest_gap_seconds"),
    )
    return out.orderBy(F.desc_nulls_last("largest_gap_seconds"), "outlet")


def health_with_silent(runs: DataFrame, outlets: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The report with a row also for outlets that had no good run (NULL time, no runs, NULL gap)."""
    return outlets.select("outlet").join(crawl_health(runs, as_of, hours), "outlet", "left").fillna({"ok_runs": 0})


def failed_runs(runs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    recent = runs.filter(F.col("started_at") > as_of - F.make_dt_interval(hours=F.lit(hours)))
    return recent.agg(F.concat(F.count_if(~F.col("ok")).cast("string"), F.lit(f" failed runs in {hours}h")).alias("report"))
