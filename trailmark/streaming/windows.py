"""Streaming forms of the counters: event-time windows with a watermark.

Each function maps a streaming (or batch) events DataFrame to an aggregated one; the
caller chooses sink, trigger and checkpoint. A watermark drops rows later than its bound;
`ingest.run_ingest` keeps rollups exact for rows of any age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.sessions import GAP_SECONDS


def _timed(stream: DataFrame, watermark: str) -> DataFrame:
    return stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark(
        "timestamp", watermark
    )


def _views() -> Column:
    return F.count_if(F.col("event_type") == "page_view").alias("pageviews")


def windowed_daily(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events and page views per day and website."""
    day = F.window("timestamp", "1 day")
    return _timed(stream, watermark).groupBy(day, "website_id").agg(
        F.count("*").alias("events"), _views()
    ).select(F.to_date("window.start").alias("date"), "website_id", "events", "pageviews")


def windowed_distinct(stream: DataFrame, watermark: str = "1 day", how: str = "exact") -> DataFrame:
    """Distinct clients per day and website.

    `exact` emits one row per (day, website, client), to be counted by the consumer,
    because a stream cannot chain a distinct with a count in update mode; state holds one
    entry per client and day. `approx` keeps a fixed-size estimate, `sketch` a mergeable
    HyperLogLog sketch.
    """
    timed = _timed(stream, watermark)
    day = F.window("timestamp", "1 day")
    if how == "exact":
        return (
            timed.withColumn("day", F.window("timestamp", "1 day"))
            .dropDuplicates(["day", "website_id", "client_id"])
            .select(F.to_date("day.start").alias("date"), "website_id", "client_id")
        )
    measures = {
        "approx": F.approx_count_distinct("client_id").alias("visitors"),
        "sketch": F.hll_sketch_agg("client_id", F.lit(12)).alias("sketch"),
    }
    if how not in measures:
        raise ValueError("how is 'exact', 'approx' or 'sketch'")
    counted = timed.groupBy(day, "website_id").agg(measures[how])
    return counted.withColumn("date", F.to_date("window.start")).drop("window")


def sliding_activity(
    stream: DataFrame, size: str = "30 minutes", slide: str = "5 minutes", watermark: str = "10 minutes"
) -> DataFrame:
    """Events, page views and estimated visitors in sliding windows per website."""
    window = F.window("timestamp", size, slide)
    return _timed(stream, watermark).groupBy(window, "website_id").agg(
        F.count("*").alias("events"),
        _views(),
        F.approx_count_distinct("client_id").alias("visitors"),
    ).select("window.start", "window.end", "website_id", "events", "pageviews", "visitors")


def stream_sessions(
    stream: DataFrame, gap_seconds: int = GAP_SECONDS, watermark: str = "1 hour"
) -> DataFrame:
    """Closed sessions: start, last event, events, page views.

    `session_window` joins events exactly one gap apart while a session ends after a
    silence of the full gap, so the window gap is one millisecond shorter.
    """
    millis = gap_seconds * 1000 - 1
    session = F.session_window("timestamp", f"{millis} milliseconds")
    return _timed(stream, watermark).groupBy(session, "website_id", "client_id").agg(
        F.max("timestamp").alias("ended_at"), F.count("*").alias("events"), _views()
    ).select(
        "website_id", "client_id",
        F.col("session_window.start").alias("started_at"), "ended_at", "events", "pageviews",
    )


def dedupe_stream(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop repeats of an `event_id` that arrive within the watermark."""
    return _timed(stream, watermark).dropDuplicatesWithinWatermark(["event_id"])


def rate_flag(
    stream: DataFrame, n: int = 60, window: str = "60 seconds", watermark: str = "5 minutes"
) -> DataFrame:
    """Requests per address and window, flagged above `n`."""
    slot = F.window("timestamp", window)
    return _timed(stream, watermark).groupBy(slot, "ip_hash").agg(
        F.count("*").alias("requests")
    ).select(
        F.col("window.start").alias("window_start"), "ip_hash", "requests",
        (F.col("requests") > n).alias("over_limit"),
    )
