"""The collector as one plan: payload rows in; events, raw and bad rows out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import enrich, validate
from trailmark.sources.tables import conform


class Ingested(NamedTuple):
    events: DataFrame
    raw: DataFrame
    bad: DataFrame


def ingest(
    payloads: DataFrame,
    ip_ranges: DataFrame | None = None,
    websites: DataFrame | None = None,
    keep_bots: bool = False,
) -> Ingested:
    """Validate, drop bots, enrich.

    Order follows the collector: rejected payloads are kept whatever their user agent;
    bots among the good ones leave no trace unless `keep_bots`. With `websites`, events of
    unregistered sites are rejected as well. Each of the three results is a plan of its
    own over the payloads, narrow except for dimension joins, so a large backfill keeps
    nothing in memory.
    """
    good, rejected = validate.split_good_bad(payloads)
    bad = validate.to_bad(rejected)
    people = enrich.drop_bots(good, keep=keep_bots)
    if websites is not None:
        site = F.left(F.try_variant_get("doc.website_id", "$", "string"), F.lit(64))
        named = people.withColumn("website_id", site)
        people, strangers = validate.filter_registered(named, websites)
        bad = bad.unionByName(validate.to_bad(strangers))
    parsed = validate.parse_events(people)
    enriched = enrich.enrich(parsed, ip_ranges)
    extra = [enrich.is_bot(F.col("user_agent")).alias("is_bot")] if keep_bots else []
    events = conform(enriched, extra)
    return Ingested(events, validate.to_raw(parsed), bad)



def parse_once(payloads: DataFrame, websites: DataFrame | None = None) -> DataFrame:
    """One row per payload: reject reason (NULL: good), bot mark, typed columns, request columns.

    Every body is parsed here and nowhere behind it. Stored, it serves all that `split` makes.
    """
    checked = validate.validate(payloads).withColumn("sent_website", validate.sent_website())
    marked = validate.parse_events(checked, "reason", "sent_website").withColumn(
        "is_bot", enrich.is_bot(F.col("user_agent"))
    )
    if websites is None:
        return marked
    known = websites.select(F.col("id").cast("string").alias("website_id")).distinct().withColumn("_known", F.lit(True))
    stranger = F.col("reason").isNull() & ~F.col("is_bot") & F.col("_known").isNull()
    return (
        marked.join(known, "website_id", "left")
        .withColumn("reason", F.when(stranger, F.lit(validate.UNKNOWN_WEBSITE)).otherwise(F.col("reason")))
        .drop("_known")
    )


def split(parsed: DataFrame, ip_ranges: DataFrame | None = None) -> Ingested:
    """Events, raw and bad rows of a `parse_once` table; the same rows as `ingest` gives."""
    good = parsed.where(F.col("reason").isNull() & ~F.col("is_bot"))
    events = conform(enrich.enrich(good, ip_ranges))
    return Ingested(events, validate.to_raw(good), validate.to_bad(parsed.where(F.col("reason").isNotNull())))
