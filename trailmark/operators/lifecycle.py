"""Data lifecycle: retention, erasure, replay, compaction."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.operators import validate
from trailmark.plans.ingest import Ingested, ingest
from trailmark.schema import TEXT_LIMITS
from trailmark.sources import tables

# How long each table keeps its rows.
TTL = {"events": "2 YEARS", "raw_events": "6 MONTHS", "bad_events": "3 MONTHS"}


def apply_retention(df: DataFrame, table: str, as_of: datetime) -> DataFrame:
    """Rows still within the table's lifetime at `as_of`.

    A row expires the moment its timestamp plus the lifetime is reached.
    """
    limit = F.lit(as_of) - F.expr(f"INTERVAL {TTL[table]}")
    kept = df.filter(F.col("timestamp") > limit)
    if "event_month" in df.columns:
        kept = kept.filter(F.col("event_month") >= F.date_format(limit, "yyyyMM"))
    return kept


# --- replacing months ----------------------------------------------------------
#
# New months are written below `_rewrite` in the table's folder. A manifest, put there in one
# step when all of them are complete, makes them the table's version for `read_table`; then
# folders are moved one by one. A job killed before the manifest leaves the old version, one
# killed after it leaves the new one, and `recover` finishes or clears up either.

_STAGE, _MANIFEST = "_rewrite", "_rewrite/manifest.json"


def _manifest(spark: SparkSession, path: str) -> dict[str, list[str]] | None:
    if not tables.exists(spark, f"{path}/{_MANIFEST}"):
        return None
    return json.loads(tables.read_text(spark, f"{path}/{_MANIFEST}"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A monthly table in one version, also while or after months are replaced."""
    plan = _manifest(spark, path)
    if plan is None:
        return spark.read.parquet(path)
    waiting = tables.folders(spark, f"{path}/{_STAGE}", "event_month")
    current = {m: f for m, f in tables.folders(spark, path, "event_month").items() if m not in (*plan["remove"], *waiting)}
    both = [(root, [f.toString() for f in found.values()])
            for root, found in ((f"{path}/{_STAGE}", waiting), (path, current)) if found]
    if not both:
        return spark.read.parquet(path).limit(0)
    parts = [spark.read.option("basePath", root).parquet(*found) for root, found in both]
    return functools.reduce(DataFrame.unionByName, parts)


def recover(spark: SparkSession, path: str) -> None:
    """Finish the replacement that a killed job had decided on; clear up one it had not."""
    plan = _manifest(spark, path)
    if plan is not None:
        for month, folder in tables.folders(spark, f"{path}/{_STAGE}", "event_month").items():
            target = f"{path}/event_month={month}"
            tables.delete(spark, target)
            tables.move(spark, folder.toString(), target)
        for month in plan["remove"]:
            tables.delete(spark, f"{path}/event_month={month}")
    tables.delete(spark, f"{path}/{_STAGE}")


def rewrite_months(
    spark: SparkSession,
    path: str,
    table: str,
    months: list[str],
    change: Callable[[DataFrame], DataFrame],
) -> None:
    """Replace the given months of a stored table by `change` of them, all at once.

    Months left without rows are removed. Batch folders left by streaming become one.
    """
    recover(spark, path)
    if not months:
        return
    new = change(spark.read.parquet(path).filter(F.col("event_month").cast("string").isin(*months)))
    below = [c for c in ("event_date", "batch_id") if c in new.columns]
    if "batch_id" in below:
        new = new.withColumn("batch_id", F.lit(-1).cast("long"))
    order = ["event_month", *tables.SORT[table]]
    staged = f"{path}/{_STAGE}"
    new.hint("rebalance", F.col("event_month")).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "event_month", *below
    ).parquet(staged)
    written = tables.folders(spark, staged, "event_month")
    tables.write_text(spark, f"{path}/{_MANIFEST}", json.dumps({"remove": sorted(set(months) - set(written))}))
    recover(spark, path)


def expire_table(spark: SparkSession, path: str, table: str, as_of: datetime) -> None:
    """Drop expired months of a stored table and rewrite the month the limit falls in."""
    row = spark.range(1).select(
        F.date_format(F.lit(as_of) - F.expr(f"INTERVAL {TTL[table]}"), "yyyyMM").alias("m")
    ).first()
    folders = tables.folders(spark, path, "event_month")
    for month, folder in folders.items():
        if month < row["m"]:
            tables.delete(spark, folder.toString())
    if row["m"] in folders:
        rewrite_months(spark, path, table, [row["m"]], lambda df: apply_retention(df, table, as_of))


def erase_clients(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Events without those of the given `client_id`s.

    The list is unhinted: Catalyst broadcasts it while it is small; for a long one the
    anti join is shuffled and adaptive execution splits a hot client.
    """
    return events.join(clients.select("client_id").distinct(), "client_id", "left_anti")


def erase_from_table(
    spark: SparkSession,
    path: str,
    clients: DataFrame,
    rollups: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
    rollup_path: str | None = None,
) -> list[str]:
    """Erase clients from the stored events, rewriting only months that hold them.

    Rollups given by name are recomputed for those months. Their dates are removed
    first: a date whose last event was erased has no new row that would replace it.
    Returns the months.
    """
    ids = clients.select("client_id").distinct()
    events = spark.read.parquet(path)
    hit = events.join(ids, "client_id", "left_semi").select(
        F.col("event_month").cast("string").alias("m")
    ).distinct()
    months = sorted(r["m"] for r in hit.collect())  # calendar months, not data
    rewrite_months(spark, path, "events", months, lambda df: erase_clients(df, clients))
    if rollups and rollup_path and months:
        kept = spark.read.parquet(path).filter(F.col("event_month").cast("string").isin(*months))
        for name, build in rollups.items():
            target = f"{rollup_path}/{name}"
            for day, folder in tables.folders(spark, target, "date").items():
                if day[:7].replace("-", "") in months:
                    tables.delete(spark, folder.toString())
            tables.write_rollup(build(kept), target)
    return months


# A client id in a body that is no JSON object.
_NAMED_CLIENT = r'"client_id"\s*:\s*"((?:[^"\\]|\\.)*)"'


def erase_from_payloads(rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Raw or bad rows without the payloads of the given `client_id`s.

    The client is the one the event would have had; a broken payload counts as that of the
    client its text names.
    """
    read = validate.parse_body(rows.withColumn("body", F.col("payload")), ("client_id",))
    sent = F.when(F.col("doc.client_id").isNotNull(), text.clip(F.col("doc.client_id"), TEXT_LIMITS["client_id"]))
    named = read.withColumn("client_id", F.coalesce(sent, F.regexp_extract("payload", _NAMED_CLIENT, 1)))
    return named.join(clients.select("client_id").distinct(), "client_id", "left_anti").select(*rows.columns)


def erase_everywhere(
    spark: SparkSession,
    out: str,
    clients: DataFrame,
    rollups: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> None:
    """Erase clients from the event, raw and bad tables below `out`, and from its rollups.

    The ids go to a table of tombstones first, which `replay` takes as `erased`: rows that a
    killed erasure has not reached yet cannot come back. Repeating the call finishes it.
    """
    clients.select("client_id").distinct().write.mode("append").parquet(f"{out}/tombstones")
    gone = spark.read.parquet(f"{out}/tombstones").distinct()
    erase_from_table(spark, f"{out}/events", gone, rollups, f"{out}/rollups")
    for table in ("raw_events", "bad_events"):
        path = f"{out}/{table}"
        for month in sorted(tables.folders(spark, path, "event_month")):
            rewrite_months(spark, path, table, [month], lambda df: erase_from_payloads(df, gone))


def replay(
    raw: DataFrame, old_events: DataFrame | None = None, erased: DataFrame | None = None
) -> Ingested:
    """Events rebuilt from stored raw payloads after a change of the logic, without erased clients.

    Raw rows hold no address, so country and city cannot be computed again; they are
    taken over from `old_events` by event id.
    """
    if erased is not None:
        raw = erase_from_payloads(raw, erased)
    payloads = raw.select(
        F.col("payload").alias("body"),
        F.lit("").alias("ip"),
        "ip_hash",
        "user_agent",
        F.col("timestamp").alias("ingest_time"),
    )
    rebuilt = ingest(payloads)
    if old_events is None:
        return rebuilt
    places = old_events.select("event_id", "country", "city").dropDuplicates(["event_id"])
    events = rebuilt.events.drop("country", "city").join(places, "event_id", "left")
    return rebuilt._replace(events=tables.conform(events))


def compact(spark: SparkSession, path: str, table: str, months: list[str]) -> None:
    """Merge the small files that streaming leaves in closed months."""
    rewrite_months(spark, path, table, months, lambda df: df)
