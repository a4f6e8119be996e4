"""Continuous ingest: payload stream to event tables and rollups.

A micro-batch is parsed once into a stored batch table; events, raw and bad rows come from it.
Rollups are kept in one of three modes:

    exact      the dates a batch touches are recomputed from the event table, which is read
               once per batch and only in the day folders of those dates
    additive   the batch's own rollups are added up at read, like an append-only store
    sketch     counters as above, distinct counts as mergeable sketches

`parts` describes the log of the last two, late rows and `late_policy`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.operators.rollups import ROLLUPS
from trailmark.plans.ingest import parse_once, split
from trailmark.sources import tables
from trailmark.streaming import parts

Rollups = Mapping[str, Callable[[DataFrame], DataFrame]]

# How often the collector hands over a batch.
FLUSH_INTERVAL = "5 seconds"
MODES = ("exact", "additive", "sketch")

# What rollups read of an event.
ROLLUP_COLUMNS = (
    "timestamp", "event_id", "website_id", "event_type", "event_name", "client_id", "session_id", "url_path",
    "referrer_domain", "utm_source", "utm_medium", "browser", "os", "device_type", "country", "currency", "value",
    "tax", "shipping", "items", "event_category", "event_value",
)
# A client clock can be wrong by any amount. Up to this many dates a batch names its dates in
# the plan; beyond, the folders are chosen by a join with them at run time.
_MAX_NAMED_DATES = 400


def _replace_batch(df: DataFrame, path: str, batch_id: int, *, daily: bool = False) -> None:
    """Write the rows of one micro-batch so that a retry replaces them.

    The batch id is a partition of its own, below the month (and the day, with `daily`): the
    second attempt overwrites what the first one left, and no other files.
    `lifecycle.compact` folds the batches of a closed month into one. At volume, use a
    trigger of minutes.
    """
    below = tables.with_month(df).withColumn("batch_id", F.lit(batch_id).cast("long"))
    folders = ["event_month", "batch_id"]
    if daily:
        below = below.withColumn("event_date", F.to_date("timestamp"))
        folders.insert(1, "event_date")
    below.hint("rebalance", *[F.col(c) for c in folders[:-1]]).sortWithinPartitions(
        *folders[:-1], "timestamp"
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def _rollup_columns(events: DataFrame) -> DataFrame:
    return events.select(*[c for c in ROLLUP_COLUMNS if c in events.columns])


def touched_events(events_path: str, batch: DataFrame) -> DataFrame | None:
    """Stored events of all dates of the batch, from their day folders alone; None without dates."""
    spark = batch.sparkSession
    dates = batch.select(F.to_date("timestamp").alias("event_date")).where(F.col("event_date").isNotNull()).distinct()
    named = sorted(r["event_date"] for r in dates.limit(_MAX_NAMED_DATES + 1).collect())
    if not named:
        return None
    events = spark.read.parquet(events_path)
    if len(named) <= _MAX_NAMED_DATES:
        months = sorted({f"{d:%Y%m}" for d in named})
        return events.filter(
            F.col("event_month").cast("string").isin(*months) & F.col("event_date").isin(*[F.lit(d) for d in named])
        )
    return events.join(F.broadcast(dates), "event_date", "left_semi")  # one row per calendar date


def refresh_rollups(
    events_path: str, rollup_path: str, batch: DataFrame, rollups: Rollups, batch_id: int = 0
) -> None:
    """Recompute the rollups of every date the batch touches, from the stored events.

    Late rows land in their own old date, which is recomputed whole, for all websites;
    untouched dates stay as they are. Exact for distinct counts too. The touched slice is
    stored, with the columns rollups need, and all rollups read that.
    """
    touched = touched_events(events_path, batch)
    if touched is None:
        return
    with tables.staged(_rollup_columns(touched), rollup_path, batch_id, "touched") as affected:
        for name, build in rollups.items():
            tables.write_rollup(build(affected), f"{rollup_path}/{name}")


def _keep_rollups(batch: DataFrame, batch_id: int, events_path: str, rollup_path: str, rollups: Rollups, mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if not rollups:
        return
    if mode == "exact":
        refresh_rollups(events_path, rollup_path, batch, rollups, batch_id)
    else:
        parts.write_parts(batch, batch_id, rollup_path, parts.rollup_parts(mode, rollups))


def ingest_batch(
    batch: DataFrame,
    batch_id: int,
    out: str,
    ip_ranges: DataFrame | None = None,
    websites: DataFrame | None = None,
    rollups: Rollups = ROLLUPS,
    mode: str = "exact",
    delay: str = "1 day",
    late_policy: str = "recompute",
) -> None:
    """One micro-batch: parsed once, three table writes, then the rollups.

    The event and raw tables hold late rows whatever the policy; it governs the rollups.
    """
    with tables.staged(parse_once(batch, websites), out, batch_id, "parsed") as parsed:
        result = split(parsed, ip_ranges)
        _replace_batch(result.raw, f"{out}/raw_events", batch_id)
        _replace_batch(result.bad, f"{out}/bad_events", batch_id)
        if not rollups:
            _replace_batch(result.events, f"{out}/events", batch_id, daily=True)
            return
        with tables.staged(result.events, out, batch_id, "events") as events:
            _replace_batch(events, f"{out}/events", batch_id, daily=True)
            counted = parts.punctual(_rollup_columns(events), batch_id, f"{out}/rollups", delay, late_policy)
            _keep_rollups(counted, batch_id, f"{out}/events", f"{out}/rollups", rollups, mode)


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    kind = {"availableNow": True} if trigger is None else {"processingTime": trigger}
    return writer.trigger(**kind).start()


def run_ingest(
    payloads: DataFrame,
    out: str,
    checkpoint: str,
    trigger: str | None = FLUSH_INTERVAL,
    ip_ranges: DataFrame | None = None,
    websites: DataFrame | None = None,
    rollups: Rollups = ROLLUPS,
    mode: str = "exact",
    delay: str = "1 day",
    late_policy: str = "recompute",
) -> StreamingQuery:
    """Start the ingest of a payload stream (see `sources.payloads.stream_payloads`).

    `trigger=None` processes what is there and stops. `out` and `checkpoint` must lie on
    storage all executors share.
    """
    return _start(
        payloads,
        lambda batch, batch_id: ingest_batch(
            batch, batch_id, out, ip_ranges, websites, rollups, mode, delay, late_policy
        ),
        checkpoint, trigger,
    )


def stream_rollups(
    events: DataFrame, events_path: str, rollup_path: str, checkpoint: str,
    rollups: Rollups = ROLLUPS, trigger: str | None = FLUSH_INTERVAL, mode: str = "exact",
    delay: str = "1 day", late_policy: str = "recompute",
) -> StreamingQuery:
    """Rollups of a stream of typed events. `exact` keeps the events; the others their parts alone."""

    def step(batch: DataFrame, batch_id: int) -> None:
        with tables.staged(batch, rollup_path, batch_id) as once:
            counted = parts.punctual(once, batch_id, rollup_path, delay, late_policy)
            if mode == "exact":
                _replace_batch(counted, events_path, batch_id, daily=True)
            _keep_rollups(counted, batch_id, events_path, rollup_path, rollups, mode)

    return _start(events, step, checkpoint, trigger)


def read_rollup(spark: SparkSession, rollup_path: str, name: str, mode: str = "exact") -> DataFrame:
    """A rollup as kept by any mode."""
    if mode == "exact":
        return spark.read.parquet(f"{rollup_path}/{name}")
    part = parts.rollup_parts(mode, {name: ROLLUPS[name]})[name]
    return parts.read_result(spark, f"{rollup_path}/{name}", part)


def read_events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/events").drop("batch_id", "event_date")
