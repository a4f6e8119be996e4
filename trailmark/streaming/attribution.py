"""First-touch attribution on a stream: events and first touches, kept batch by batch.

Each batch leaves its events and the first touch of each of its sessions (see `parts`); reading
takes the earliest touch of all batches and stamps the events with it. So a first event that
arrives late still decides, whatever was stored before it, unless `late_policy` keeps it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trailmark.operators import sessions
from trailmark.streaming import parts

PARTS = {
    "events": parts.Part(lambda events: events, lambda stored: stored),
    "touches": parts.Part(sessions.first_touch, sessions.merge_touch),
}


def run_attribution(
    events: DataFrame, out: str, checkpoint: str, trigger: str | None = None,
    delay: str = "1 day", late_policy: str = "recompute",
) -> StreamingQuery:
    """Keep a stream of events and its first touches below `out`."""
    return parts.run_parts(events, PARTS, out, checkpoint, trigger, delay, late_policy)


def read_attribution(spark: SparkSession, out: str) -> DataFrame:
    """Events with campaign columns, referrer and `landing_page` of their session's first event."""
    stored = {name: parts.read_result(spark, f"{out}/{name}", part) for name, part in PARTS.items()}
    return sessions.stamp_touch(stored["events"], stored["touches"])


def fold(spark: SparkSession, out: str) -> None:
    for name, part in PARTS.items():
        parts.fold(spark, f"{out}/{name}", part)
