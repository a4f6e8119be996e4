"""Streams whose results are kept as a log of per-batch parts.

A micro-batch leaves one part: its own rows aggregated, in a folder named after the batch, so a
repeated batch replaces its part and nothing else. Reading merges all parts. Merging is
associative, so `fold` can replace any first stretch of the log by one merged part: it writes
`folds/upto=N`, and readers take the newest complete fold and the batches behind it. A fold that
was killed has no `_SUCCESS` file and is not seen; folding again overwrites it.

Rows of any lateness count, because no state is ever closed. `late_policy` says what becomes of
rows behind the watermark (the largest event time of earlier batches less the delay):

    recompute   they count like any other; the result is complete
    side        they are kept in `late/` and do not count
    drop        they are left out
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.operators import rollups, sessions
from trailmark.sources import tables

LATE_POLICIES = ("recompute", "side", "drop")


class Part(NamedTuple):
    """How a batch becomes a part (`build`), parts one part (`merge`), and a part the result."""

    build: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame] = lambda df: df


# --- the log -----------------------------------------------------------------


def write_part(part: DataFrame, path: str, batch_id: int) -> None:
    part.write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")


def _complete(spark: SparkSession, path: str, column: str) -> dict[int, str]:
    """Number -> folder of the finished folders."""
    found = tables.folders(spark, path, column)
    return {int(k): v.toString() for k, v in found.items() if tables.exists(spark, f"{v.toString()}/_SUCCESS")}


def _log(spark: SparkSession, path: str) -> tuple[dict[int, str], dict[int, str], int]:
    """Batches behind the newest fold, all folds, and the fold's last batch (-1: none)."""
    folds = _complete(spark, f"{path}/folds", "upto")
    upto = max(folds, default=-1)
    batches = {k: v for k, v in _complete(spark, f"{path}/batches", "batch_id").items() if k > upto}
    return batches, folds, upto


def read_parts(spark: SparkSession, path: str) -> DataFrame | None:
    """All parts that count, unmerged; None for a log without parts."""
    batches, folds, upto = _log(spark, path)
    chosen = [*([folds[upto]] if folds else []), *(batches[k] for k in sorted(batches))]
    return spark.read.parquet(*chosen) if chosen else None


def read_result(spark: SparkSession, path: str, part: Part) -> DataFrame:
    parts = read_parts(spark, path)
    if parts is None:
        raise FileNotFoundError(f"no parts below {path}")
    return part.finish(part.merge(parts))


def fold(spark: SparkSession, path: str, part: Part) -> int:
    """Merge all parts written so far into one; returns the last batch it holds.

    A batch that is repeated after its fold is written again, and not read.
    """
    batches, folds, upto = _log(spark, path)
    if batches:
        last = max(batches)
        part.merge(read_parts(spark, path)).write.mode("overwrite").parquet(f"{path}/folds/upto={last}")
    else:
        last = upto
    for k, folder in _complete(spark, f"{path}/folds", "upto").items():
        if k < last:
            tables.delete(spark, folder)
    for k, folder in _complete(spark, f"{path}/batches", "batch_id").items():
        if k <= last:
            tables.delete(spark, folder)
    return last


# --- late rows ---------------------------------------------------------------


def punctual(batch: DataFrame, batch_id: int, out: str, delay: str, late_policy: str) -> DataFrame:
    """Rows of the batch that count under the policy; notes the batch's largest event time.

    The watermark of a batch rests on earlier batches alone, so a repeated batch meets the same.
    """
    if late_policy not in LATE_POLICIES:
        raise ValueError(f"late_policy is one of {LATE_POLICIES}")
    spark = batch.sparkSession
    seen = {k: v for k, v in _complete(spark, f"{out}/progress", "batch_id").items() if k < batch_id}
    before = spark.read.parquet(seen[max(seen)]).first()["latest"] if seen else None
    own = batch.agg(F.greatest(F.max("timestamp"), F.lit(before).cast("timestamp")).alias("latest"))
    own.write.mode("overwrite").parquet(f"{out}/progress/batch_id={batch_id}")
    if late_policy == "recompute" or before is None:
        return batch
    late = F.coalesce(F.col("timestamp") < F.lit(before) - F.expr(f"INTERVAL {delay}"), F.lit(False))
    if late_policy == "side":
        batch.where(late).write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")
    return batch.where(~late)


def read_late(spark: SparkSession, out: str) -> DataFrame | None:
    """Rows that the `side` policy kept apart."""
    found = _complete(spark, f"{out}/late", "batch_id")
    return spark.read.parquet(*found.values()) if found else None


# --- the job -----------------------------------------------------------------


def write_parts(batch: DataFrame, batch_id: int, out: str, parts: Mapping[str, Part]) -> None:
    for name, part in parts.items():
        write_part(part.build(batch), f"{out}/{name}", batch_id)


def run_parts(
    stream: DataFrame,
    parts: Mapping[str, Part],
    out: str,
    checkpoint: str,
    trigger: str | None = None,
    delay: str = "1 day",
    late_policy: str = "recompute",
) -> StreamingQuery:
    """Keep the named results of a stream of events below `out`.

    Each batch is stored once and read by all parts. `trigger=None` processes what is there
    and stops.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        with tables.staged(batch, out, batch_id) as once:
            write_parts(punctual(once, batch_id, out, delay, late_policy), batch_id, out, parts)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    kind = {"availableNow": True} if trigger is None else {"processingTime": trigger}
    return writer.trigger(**kind).start()


def run_updates(
    aggregated: DataFrame, keys: Sequence[str], out: str, checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Update-mode sink: each batch leaves the rows it changed, readers take the newest per key.

    For aggregations that hold their state behind a watermark (`streaming.windows`). Rows are
    there as soon as they change, so none waits for the watermark to close its window; read
    them with `upserts(keys)`.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        write_part(batch.withColumn("_batch", F.lit(batch_id).cast("long")), out, batch_id)

    writer = aggregated.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step)
    kind = {"availableNow": True} if trigger is None else {"processingTime": trigger}
    return writer.trigger(**kind).start()


def upserts(keys: Sequence[str]) -> Part:
    """Newest row per key of a log written by `run_updates`."""

    def merge(parts: DataFrame) -> DataFrame:
        rest = [c for c in parts.columns if c not in keys]
        newest = F.max_by(F.struct(*rest), "_batch").alias("_row")
        return parts.groupBy(*keys).agg(newest).select(*keys, "_row.*")

    return Part(lambda df: df, merge, lambda df: df.drop("_batch"))


# --- rollups -----------------------------------------------------------------


def _additive(name: str, build: Callable[[DataFrame], DataFrame]) -> Part:
    spec = rollups.SPECS[name]
    keys = ["date", "website_id", *spec.keys]

    def merge(parts: DataFrame) -> DataFrame:
        sums = [*spec.sums, *spec.distinct]
        label = [F.min(F.struct(*spec.labels)).alias("_label")] if spec.labels else []
        merged = parts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums], *label)
        return merged.select(*keys, *(["_label.*"] if spec.labels else []), *sums)

    return Part(build, merge)


def _sketched(name: str, build: Callable[[DataFrame], DataFrame]) -> Part:
    spec = rollups.SPECS[name]
    if not spec.distinct:
        return _additive(name, build)
    keys = ["date", "website_id", *spec.keys]

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys).agg(
            *[F.sum(s).alias(s) for s in spec.sums], *[F.hll_union_agg(d).alias(d) for d in spec.distinct]
        )

    def finish(merged: DataFrame) -> DataFrame:
        return merged.withColumns({d: F.hll_sketch_estimate(d) for d in spec.distinct})

    return Part(lambda events: rollups.sketch_part(events, spec), merge, finish)


def rollup_parts(mode: str, chosen: Mapping[str, Callable[[DataFrame], DataFrame]] = rollups.ROLLUPS) -> dict[str, Part]:
    """Parts of the named rollups.

    `additive` adds up all measures of the batches, distinct counts too, as an append-only
    store does: a visitor of two batches counts twice. `sketch` keeps a mergeable sketch per
    distinct count and estimates at read.
    """
    kinds = {"additive": _additive, "sketch": _sketched}
    if mode not in kinds:
        raise ValueError("mode is 'additive' or 'sketch'")
    return {name: kinds[mode](name, build) for name, build in chosen.items()}


# --- windows and sessions ----------------------------------------------------


def _summed(keys: Sequence[str], sums: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda parts: parts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def _views() -> Column:
    return F.count_if(F.col("event_type") == "page_view").alias("pageviews")


def daily_windows() -> Part:
    """Events and page views per day and website."""
    keys = ["date", "website_id"]

    def build(events: DataFrame) -> DataFrame:
        return events.groupBy(F.to_date("timestamp").alias("date"), "website_id").agg(
            F.count("*").alias("events"), _views())

    return Part(build, _summed(keys, ["events", "pageviews"]))


def sliding_windows(size: str = "30 minutes", slide: str = "5 minutes") -> Part:
    """Events, page views and estimated visitors in sliding windows per website."""
    keys = ["start", "end", "website_id"]

    def build(events: DataFrame) -> DataFrame:
        return events.groupBy(F.window("timestamp", size, slide), "website_id").agg(
            F.count("*").alias("events"), _views(),
            F.hll_sketch_agg(rollups.countable("client_id"), F.lit(12)).alias("visitors"),
        ).select("window.start", "window.end", "website_id", "events", "pageviews", "visitors")

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys).agg(
            F.sum("events").alias("events"), F.sum("pageviews").alias("pageviews"),
            F.hll_union_agg("visitors").alias("visitors"))

    return Part(build, merge, lambda df: df.withColumn("visitors", F.hll_sketch_estimate("visitors")))


def rate_windows(n: int = 60, window: str = "60 seconds", address: str = "ip_hash") -> Part:
    """Requests per address and window, flagged above `n`; requests without an address don't count."""

    def build(events: DataFrame) -> DataFrame:
        known = events.where(F.col(address) != "")
        return known.groupBy(F.window("timestamp", window), address).agg(F.count("*").alias("requests")).select(
            F.col("window.start").alias("window_start"), address, "requests")

    return Part(build, _summed(["window_start", address], ["requests"]),
                lambda df: df.withColumn("over_limit", F.col("requests") > n))


def distinct_clients(how: str = "exact") -> Part:
    """Distinct clients per day and website; `exact` keeps the clients, `sketch` a sketch."""

    def day() -> Column:
        return F.to_date("timestamp").alias("date")

    if how == "exact":
        return Part(
            lambda events: events.select(day(), "website_id", "client_id").distinct(),
            lambda parts: parts.distinct(),
            lambda df: df.groupBy("date", "website_id").agg(F.count("client_id").alias("visitors")),
        )
    if how == "sketch":
        return Part(
            lambda events: events.groupBy(day(), "website_id").agg(
                F.hll_sketch_agg(rollups.countable("client_id"), F.lit(12)).alias("visitors")),
            lambda parts: parts.groupBy("date", "website_id").agg(F.hll_union_agg("visitors").alias("visitors")),
            lambda df: df.withColumn("visitors", F.hll_sketch_estimate("visitors")),
        )
    raise ValueError("how is 'exact' or 'sketch'")


def session_parts(gap_seconds: int = sessions.GAP_SECONDS) -> Part:
    """Sessions: start, last event, events, page views.

    A part holds the sessions within its batch. Parts of one visitor are joined where less
    than the gap lies between them; a window runs over sessions, not over events.
    """
    visitor = list(sessions.VISITOR)

    def build(events: DataFrame) -> DataFrame:
        return sessions.session_table(events, gap_seconds).select(*visitor, "started_at", "ended_at", "events", "pageviews")

    def merge(parts: DataFrame) -> DataFrame:
        order = Window.partitionBy(*visitor).orderBy("started_at", "ended_at")
        earlier = F.max("ended_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
        silent = F.unix_micros("started_at") - F.unix_micros("_earlier") >= gap_seconds * 1_000_000
        numbered = parts.withColumn("_earlier", earlier).withColumn(
            "_session", F.sum(F.coalesce(silent, F.lit(True)).cast("long")).over(order))
        return numbered.groupBy(*visitor, "_session").agg(
            F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
            F.sum("events").alias("events"), F.sum("pageviews").alias("pageviews")).drop("_session")

    return Part(build, merge)
