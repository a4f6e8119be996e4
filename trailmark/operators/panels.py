"""Dashboard panels: traffic over time, rankings, shares, live counters, page quality."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.reports import _at, _since

GRAINS = ("hour", "day", "week", "month")


def _is_view() -> Column:
    return F.col("event_type") == "page_view"


def period(grain: str, column: str = "timestamp") -> Column:
    """Start date of the period; weeks begin on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"grain is one of {GRAINS}")
    start = F.date_trunc(grain, column)
    return start if grain == "hour" else F.to_date(start)


def scope(
    events: DataFrame,
    start: date | datetime | None = None,
    end: date | datetime | None = None,
    websites: Sequence[str] = (),
) -> DataFrame:
    """Events in [start, end) of the given websites; no bound or list means no limit.

    On a table with `event_month` the range also prunes the monthly partitions.
    """
    out = events
    monthly = "event_month" in events.columns
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
        if monthly:
            out = out.filter(F.col("event_month") >= f"{start:%Y%m}")
    if end is not None:
        out = out.filter(F.col("timestamp") < F.lit(end).cast("timestamp"))
        if monthly:
            out = out.filter(F.col("event_month") <= f"{end:%Y%m}")
    if websites:
        out = out.filter(F.col("website_id").isin(*websites))
    return out


def traffic_series(events: DataFrame, grain: str = "day") -> DataFrame:
    """Page views per website and period."""
    return events.filter(_is_view()).groupBy("website_id", period(grain).alias("period")).agg(
        F.count("*").alias("pageviews")
    )


def unique_visitors(events: DataFrame, grain: str = "day", exact: bool = True) -> DataFrame:
    """Distinct clients per website and period, exact or estimated."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return events.groupBy("website_id", period(grain).alias("period")).agg(
        count("client_id").alias("visitors")
    )


def top_pages(events: DataFrame, n: int = 10) -> DataFrame:
    """Most viewed pages of each website; ties go to the smaller path."""
    pages = events.filter(_is_view()).groupBy("website_id", "url_path").agg(
        F.count("*").alias("pageviews"), F.count_distinct("client_id").alias("visitors")
    )
    order = Window.partitionBy("website_id").orderBy(F.desc("pageviews"), "url_path")
    return pages.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _shares(events: DataFrame, keys: Sequence[str], base: Sequence[str] = ("website_id",)) -> DataFrame:
    """Page views and visitors per key with the key's share of the website's page views.

    Totals are a second small aggregation joined back, not a window that would gather
    all keys of a large website in one task.
    """
    parts = events.filter(_is_view()).groupBy(*base, *keys).agg(
        F.count("*").alias("pageviews"), F.count_distinct("client_id").alias("visitors")
    )
    totals = events.filter(_is_view()).groupBy(*base).agg(F.count("*").alias("total"))
    return (
        parts.join(totals, list(base))
        .withColumn("share", F.col("pageviews") / F.col("total"))
        .drop("total")
    )


def traffic_sources(events: DataFrame) -> DataFrame:
    return _shares(events, ["referrer_domain", "utm_source", "utm_medium"])


def device_share(events: DataFrame) -> DataFrame:
    return _shares(events, ["browser", "device_type"])


def country_share(events: DataFrame) -> DataFrame:
    return _shares(events, ["country"])


def realtime(
    events: DataFrame, as_of: datetime | Column | None = None, interval: str = "5 MINUTES"
) -> DataFrame:
    """Per website: events, visitors and page views of the last minutes."""
    return (
        events.filter(_since(_at(as_of), interval))
        .groupBy("website_id")
        .agg(
            F.count("*").alias("events"),
            F.count_distinct("client_id").alias("visitors"),
            F.count_if(_is_view()).alias("pageviews"),
        )
    )


SCROLL_MARKS = (25, 50, 75, 100)


def scroll_depth_dist(events: DataFrame) -> DataFrame:
    """Per website: scroll events, and how many reached each depth."""
    depth = F.col("scroll_depth")
    return events.filter(depth > 0).groupBy("website_id").agg(
        F.count("*").alias("scrolls"),
        *[F.count_if(depth >= mark).alias(f"reached_{mark}") for mark in SCROLL_MARKS],
    )


VITALS = ("lcp_value", "fid_value", "cls_value", "inp_value")


def _measurements(events: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(website, page, metric, value) for every positive measurement."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    return (
        events.filter(" OR ".join(f"{m} > 0" for m in metrics))
        .select("website_id", "url_path", F.explode(F.array(*pairs)).alias("m"))
        .select("website_id", "url_path", "m.metric", "m.value")
        .filter(F.col("value") > 0)
    )


def web_vitals(
    events: DataFrame,
    percentiles: Sequence[int] = (50, 75, 95),
    metrics: Sequence[str] = VITALS,
    exact: bool = True,
) -> DataFrame:
    """Percentiles of each page-quality metric per page: `p50, p75, ...`.

    The exact form returns the smallest value whose cumulative share reaches the
    percentile. Values are counted first (map-side), then grouped in buckets of about
    1 % width: a window over the few buckets of a page finds where each percentile lies,
    and only within a bucket are values ranked. No page is ever gathered in one task.
    `exact=False` uses Spark's mergeable quantile summary.
    """
    rows = _measurements(events, metrics)
    page = ["website_id", "url_path", "metric"]
    if not exact:
        return rows.groupBy(*page).agg(
            F.count("*").alias("samples"),
            *[F.percentile_approx("value", p / 100, 10_000).alias(f"p{p}") for p in percentiles],
        )
    counted = rows.groupBy(*page, "value").agg(F.count("*").alias("n")).withColumn(
        "bucket", F.floor(F.log("value") * 100).cast("long")
    )
    bucket_order = Window.partitionBy(*page).orderBy("bucket")
    buckets = counted.groupBy(*page, "bucket").agg(F.sum("n").alias("bucket_n")).select(
        *page,
        "bucket",
        (F.sum("bucket_n").over(bucket_order) - F.col("bucket_n")).alias("before"),
        F.sum("bucket_n").over(Window.partitionBy(*page)).alias("samples"),
    )
    value_order = Window.partitionBy(*page, "bucket").orderBy("value")
    ranked = counted.join(buckets, [*page, "bucket"]).withColumn(
        "reached", F.col("before") + F.sum("n").over(value_order)
    )
    picks = [
        F.min(F.when(F.col("reached") * 100 >= F.col("samples") * p, F.col("value"))).alias(f"p{p}")
        for p in percentiles
    ]
    return ranked.groupBy(*page).agg(F.max("samples").alias("samples"), *picks)
