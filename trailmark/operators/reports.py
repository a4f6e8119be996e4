"""Report queries over the event table.

Where the product asks for one website or one client, `website=None` / `client=None`
answers for all of them in one job: top-n lists become ranked lists per key, and the rank
filter is applied before the shuffle too, so a dominant key sends n rows per task.
`as_of` replaces the wall clock; it is a datetime, a Column or a scalar subquery.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.operators.ranking import top_rows

ID_PREFIX = 8  # characters of an id shown in lists


def _at(as_of: datetime | Column | None) -> Column:
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def latest(events: DataFrame) -> Column:
    """Newest event time as a scalar subquery, for reports over a closed data set."""
    return events.agg(F.max("timestamp")).scalar()


def _since(as_of: Column, interval: str) -> Column:
    return F.col("timestamp") >= as_of - F.expr(f"INTERVAL {interval}")


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def _local(tz: str, column: str = "timestamp") -> Column:
    return F.from_utc_timestamp(column, tz)


def _short(column: str) -> Column:
    return F.left(column, F.lit(ID_PREFIX))


def _scoped(events: DataFrame, website: str | None) -> DataFrame:
    return events if website is None else events.filter(F.col("website_id") == website)


def _newest(
    events: DataFrame, n: int, website: str | None, ties: tuple[str, ...] = ("event_id",)
) -> DataFrame:
    """Newest `n` rows of one website, or of each website with their `position`."""
    order = [F.desc("timestamp"), *[F.desc(t) for t in ties]]
    if website is not None:
        return _scoped(events, website).orderBy(*order).limit(n)
    per_site = Window.partitionBy("website_id").orderBy(*order)
    return events.withColumn("position", F.row_number().over(per_site)).filter(F.col("position") <= n)


def _position(website: str | None) -> list[str]:
    return ["website_id", "position"] if website is None else []


def sites_overview(events: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """One row per website: totals, visitors, time span and recent activity."""
    now = _at(as_of)
    recent = _since(now, "30 MINUTES")
    return (
        events.groupBy("website_id")
        .agg(
            F.count("*").alias("total_events"),
            F.count_if(_is("page_view")).alias("pageviews"),
            F.count_distinct("client_id").alias("unique_visitors"),
            F.count_distinct("session_id").alias("sessions"),
            F.min("timestamp").alias("first_event"),
            F.max("timestamp").alias("last_event"),
            F.count_if(_since(now, "1 HOUR")).alias("events_last_hour"),
            F.count_if(_since(now, "24 HOURS")).alias("events_last_24h"),
            F.count_if(_since(now, "5 MINUTES")).alias("events_last_5min"),
            F.count_distinct(F.when(recent, F.col("client_id"))).alias("visitors_last_30min"),
            F.count_if(recent).alias("events_last_30min"),
        )
        .orderBy(F.desc("total_events"), "website_id")
    )


_STAT_COUNTERS = {
    "pageviews": "page_view",
    "session_starts": "session_start",
    "scrolls": "scroll",
    "custom_events": "custom",
    "purchases": "purchase",
    "add_to_carts": "add_to_cart",
    "view_items": "view_item",
}


def site_stats(
    events: DataFrame,
    website: str | None = None,
    hours: int = 24,
    as_of: datetime | Column | None = None,
) -> DataFrame:
    """Counters of the last hours for one website (always one row) or for each."""
    recent = _scoped(events, website).filter(_since(_at(as_of), f"{int(hours)} HOURS"))
    measures = [
        F.count("*").alias("total_events"),
        *[F.count_if(_is(kind)).alias(name) for name, kind in _STAT_COUNTERS.items()],
        F.count_distinct("client_id").alias("unique_visitors"),
        F.count_distinct("session_id").alias("sessions"),
        F.min("timestamp").alias("first_event"),
        F.max("timestamp").alias("last_event"),
    ]
    return recent.groupBy("website_id").agg(*measures) if website is None else recent.agg(*measures)


def recent_events(
    events: DataFrame, website: str | None = None, n: int = 50, tz: str = "UTC"
) -> DataFrame:
    """Newest events with local time and shortened ids."""
    return _newest(events, n, website).select(
        *_position(website),
        _local(tz).alias("ts"),
        "event_type", "event_name", "url_path", "browser", "os", "device_type",
        "referrer_domain", "country", "city",
        _short("client_id").alias("client_short"),
        _short("session_id").alias("session_short"),
    )


def hourly_breakdown(
    events: DataFrame,
    website: str | None = None,
    hours: int = 24,
    tz: str = "UTC",
    as_of: datetime | Column | None = None,
    fill: bool = False,
) -> DataFrame:
    """Events, visitors and page views per local hour; `fill` adds the empty hours."""
    now = _at(as_of)
    recent = _scoped(events, website).filter(_since(now, f"{int(hours)} HOURS"))
    out = recent.groupBy("website_id", F.date_trunc("hour", _local(tz)).alias("hour")).agg(
        F.count("*").alias("events"),
        F.count_distinct("client_id").alias("visitors"),
        F.count_if(_is("page_view")).alias("pageviews"),
    )
    if fill:
        end = F.date_trunc("hour", F.from_utc_timestamp(now, tz))
        start = F.date_trunc(
            "hour", F.from_utc_timestamp(now - F.expr(f"INTERVAL {int(hours)} HOURS"), tz)
        )
        grid = out.select("website_id").distinct().withColumn(
            "hour", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR")))
        )
        out = grid.join(out, ["website_id", "hour"], "left").fillna(
            0, ["events", "visitors", "pageviews"]
        )
    return out.orderBy("website_id", "hour")


def recent_bad_events(
    bad: DataFrame, website: str | None = None, n: int = 20, tz: str = "UTC"
) -> DataFrame:
    """Newest rejected payloads with a short preview."""
    return _newest(bad, n, website, ("payload", "reason")).select(
        *_position(website),
        _local(tz).alias("ts"),
        "reason",
        F.left("payload", F.lit(200)).alias("payload_preview"),
    )


# Columns of the detail report; item columns are the arrays of one item field.
DETAIL_COLUMNS = (
    "event_type", "event_name", "client_id", "session_id", "url_path", "url_query", "page_title",
    "referrer", "referrer_domain", "utm_source", "utm_medium", "utm_campaign", "utm_term",
    "utm_content", "country", "city", "browser", "browser_version", "os", "device_type", "screen",
    "language", "transaction_id", "affiliation", "currency", "value", "tax", "shipping", "coupon",
    "payment_type", "shipping_tier", "item_list_id", "item_list_name", "promotion_id",
    "promotion_name",
)
DETAIL_ITEMS = {
    "item_ids": "item_id", "item_names": "item_name", "item_brands": "item_brand",
    "item_categories": "item_category", "item_variants": "item_variant", "item_prices": "price",
    "item_quantities": "quantity", "item_discounts": "discount",
}
DETAIL_INTERACTION = (
    "event_category", "event_label", "event_value", "click_element", "click_text", "click_url",
    "click_id", "scroll_depth", "form_id", "form_name", "search_term", "lcp_value", "cls_value",
    "inp_value", "properties",
)
MAX_DETAIL_ROWS = 200


def event_detail(
    events: DataFrame,
    website: str | None = None,
    event_type: str | None = None,
    client_prefix: str | None = None,
    n: int = 50,
    tz: str = "UTC",
) -> DataFrame:
    """Newest events with every reported parameter, at most 200 (per website)."""
    chosen = events
    if event_type:
        chosen = chosen.filter(F.col("event_type") == event_type)
    if client_prefix:
        chosen = chosen.filter(F.col("client_id").startswith(client_prefix))
    return _newest(chosen, min(n, MAX_DETAIL_ROWS), website).select(
        *_position(website),
        _local(tz).alias("ts"),
        *DETAIL_COLUMNS,
        *[F.col(f"items.{field}").alias(name) for name, field in DETAIL_ITEMS.items()],
        *DETAIL_INTERACTION,
    )


def event_fill_profile(detail: DataFrame) -> DataFrame:
    """Which parameters of each detail row are filled and which are empty.

    Empty means '', '0', 0, an empty list or an empty map.
    """
    skipped = {"ts", "website_id", "position"}
    entries = []
    for field in detail.schema.fields:
        if field.name in skipped:
            continue
        value = F.col(field.name)
        kind = field.dataType.typeName()
        if kind == "string":
            empty = value.isin("", "0")
        elif kind in ("array", "map"):
            empty = F.size(value) == 0
        else:
            empty = value == 0
        shown = F.to_json(value) if kind in ("array", "map") else value.cast("string")
        entries.append(F.struct(
            F.lit(field.name).alias("key"),
            shown.alias("value"),
            F.coalesce(empty, F.lit(True)).alias("empty"),
        ))
    kept = [c for c in ("website_id", "position") if c in detail.columns]
    filled = F.filter("params", lambda p: ~p["empty"])
    empty = F.filter("params", lambda p: p["empty"])
    return detail.withColumn("params", F.array(*entries)).select(
        *kept, "ts", "event_type", "event_name", "client_id", "url_path",
        F.transform(filled, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
        .alias("filled_params"),
        F.transform(empty, lambda p: p["key"]).alias("empty_params"),
        F.size(filled).alias("filled_count"),
        F.size(empty).alias("empty_count"),
    )


COVERAGE_TEXTS = (
    "url_path", "page_title", "client_id", "session_id", "referrer", "referrer_domain",
    "utm_source", "utm_medium", "utm_campaign", "country", "city", "browser", "os", "device_type",
    "screen", "language", "transaction_id", "currency", "event_category", "event_label",
    "click_text", "search_term",
)


def param_coverage(events: DataFrame, website: str | None = None) -> DataFrame:
    """Per event type, how many events carry each parameter."""
    counters = [F.count_if(F.col(c) != "").alias(f"has_{c}") for c in COVERAGE_TEXTS]
    counters += [
        F.count_if(F.col("value") > 0).alias("has_value"),
        F.count_if(F.size("items") > 0).alias("has_items"),
        F.count_if(F.size(F.map_keys("properties")) > 0).alias("has_properties"),
        F.count_if(F.col("scroll_depth") > 0).alias("has_scroll_depth"),
    ]
    keys = ["event_type"] if website is not None else ["website_id", "event_type"]
    return (
        _scoped(events, website)
        .groupBy(*keys)
        .agg(F.count("*").alias("total"), *counters)
        .orderBy(F.desc("total"), *keys)
    )


def monthly_usage(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("website_id", F.to_date(F.date_trunc("month", "timestamp")).alias("month"))
        .agg(
            F.count("*").alias("events"),
            F.count_distinct("client_id").alias("visitors"),
            F.count_if(_is("page_view")).alias("pageviews"),
            F.count_if(_is("purchase")).alias("purchases"),
        )
        .orderBy(F.desc("month"), F.desc("events"), "website_id")
    )


# The cost model, in USD per month.
FREE_EVENTS = 10_000_000
COST_PER_BLOCK = 50
HOSTING_COST = 5
DATABASE_COST = 0


def cost_estimate(usage: DataFrame) -> DataFrame:
    """Monthly cost estimate from the usage report: one row."""
    total = F.coalesce(F.sum("events"), F.lit(0))
    storage = F.when(total < FREE_EVENTS, F.lit(0)).otherwise(
        F.ceil(total / FREE_EVENTS) * COST_PER_BLOCK
    )
    return usage.agg(total.alias("total_events"), storage.cast("long").alias("storage_cost")).select(
        "total_events",
        "storage_cost",
        F.lit(HOSTING_COST).cast("long").alias("hosting_cost"),
        F.lit(DATABASE_COST).cast("long").alias("database_cost"),
        (F.col("storage_cost") + HOSTING_COST + DATABASE_COST).alias("total_cost"),
    )


def bad_event_rate(
    bad: DataFrame,
    events: DataFrame,
    as_of: datetime | Column | None = None,
    interval: str = "1 HOUR",
    threshold: float = 0.05,
) -> DataFrame:
    """Rejected and accepted events of the last hour, their ratio and an alert flag: one row."""
    now = _at(as_of)
    parts = bad.filter(_since(now, interval)).agg(
        F.count("*").alias("bad"), F.lit(0).cast("long").alias("good")
    ).unionByName(
        events.filter(_since(now, interval)).agg(
            F.lit(0).cast("long").alias("bad"), F.count("*").alias("good")
        )
    )
    total = F.col("bad") + F.col("good")
    ratio = F.when(total > 0, F.col("bad") / total).otherwise(F.lit(0.0))
    return parts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).select(
        "bad", "good", ratio.alias("bad_ratio"), (ratio > threshold).alias("alert")
    )


MAX_LIVE_ROWS = 100


def live_events(
    events: DataFrame, website: str | None = None, n: int = 30, tz: str = "UTC"
) -> DataFrame:
    """Newest events of all websites together, or of one; at most 100."""
    return (
        _scoped(events, website)
        .orderBy(F.desc("timestamp"), F.desc("event_id"))
        .limit(min(n, MAX_LIVE_ROWS))
        .select(
            _local(tz).alias("ts"),
            "event_type", "event_name", "website_id", "url_path", "page_title", "browser", "os",
            "device_type", "referrer_domain", "country", "city", "client_id",
            _short("client_id").alias("client_short"),
            "value", "transaction_id",
        )
    )


PROFILE_COLUMNS = ("browser", "os", "device_type", "country", "city", "language", "screen")


def _profile_measures(tz: str) -> list[Column]:
    first = F.min(F.struct("timestamp", "event_id", *PROFILE_COLUMNS))
    return [
        F.count("*").alias("total_events"),
        F.count_if(_is("page_view")).alias("pageviews"),
        F.count_if(_is("purchase")).alias("purchases"),
        F.count_if(_is("add_to_cart")).alias("add_to_carts"),
        F.from_utc_timestamp(F.min("timestamp"), tz).alias("first_seen"),
        F.from_utc_timestamp(F.max("timestamp"), tz).alias("last_seen"),
        first.alias("first"),
    ]


def _summary(events: DataFrame, keys: list[str], tz: str) -> DataFrame:
    """Per-client totals; profile columns are those of the client's first event.

    The first pass is per session, so sessions are counted without a second distinct and
    a client with very many rows is combined before it is brought together.
    """
    per_session = events.groupBy(*keys, "session_id").agg(*_profile_measures(tz))
    sums = ("total_events", "pageviews", "purchases", "add_to_carts")
    return (
        per_session.groupBy(*keys)
        .agg(
            *[F.sum(s).alias(s) for s in sums],
            F.count("*").alias("total_sessions"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min("first").alias("first"),
        )
        .select(
            *keys, *sums, "total_sessions", "first_seen", "last_seen",
            *[F.col(f"first.{c}").alias(c) for c in PROFILE_COLUMNS],
        )
    )


def client_summary(
    events: DataFrame, client: str, website: str | None = None, tz: str = "UTC"
) -> DataFrame:
    """Totals and profile of one client."""
    return _summary(_scoped(events, website).filter(F.col("client_id") == client), ["client_id"], tz)


def client_profiles(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """`client_summary` for every client of every website."""
    return _summary(events, ["website_id", "client_id"], tz)


TIMELINE_COLUMNS = (
    "event_type", "event_name", "session_id", "url_path", "url_query", "page_title", "referrer",
    "referrer_domain", "utm_source", "utm_medium", "utm_campaign", "country", "city", "browser",
    "device_type", "scroll_depth", "transaction_id", "currency", "value",
)
TIMELINE_ITEMS = {"item_ids": "item_id", "item_names": "item_name", "item_prices": "price"}
TIMELINE_DETAILS = ("event_category", "event_label", "click_text", "search_term", "properties")
MAX_TIMELINE = 500


def client_timeline(
    events: DataFrame,
    client: str | None = None,
    website: str | None = None,
    max_events: int | None = MAX_TIMELINE,
    tz: str = "UTC",
) -> DataFrame:
    """Events of a client, oldest first; `client=None` gives every client's timeline.

    `position` counts from 1 within the client. `max_events=None` lifts the report's
    limit; the rows then come unnumbered, because numbering would bring a whole client
    into one task.
    """
    chosen = _scoped(events, website)
    if client is not None:
        chosen = chosen.filter(F.col("client_id") == client)
    shown = [
        "event_id", _local(tz).alias("ts"), *TIMELINE_COLUMNS,
        *[F.col(f"items.{field}").alias(name) for name, field in TIMELINE_ITEMS.items()],
        *TIMELINE_DETAILS,
    ]
    if max_events is None:
        return chosen.select("client_id", *shown).orderBy("client_id", "ts", "event_id")
    order = [F.col("timestamp"), F.col("event_id")]
    ranked = top_rows(chosen, ["client_id"], order, max_events, "position", "event_id")
    return ranked.select("client_id", "position", *shown)


def client_journey(timeline: DataFrame, with_events: bool = False) -> DataFrame:
    """Timeline rows grouped into sessions, latest-started session first.

    Blank session ids form the session `unknown`. Source and landing page are those of
    the session's first event. `with_events` attaches the ordered events and is meant for
    limited timelines, where a session holds at most `max_events` rows.
    """
    if with_events and "position" not in timeline.columns:
        raise ValueError("with_events needs a timeline limited by max_events")
    session = F.when(F.col("session_id") == "", F.lit("unknown")).otherwise(F.col("session_id"))
    first = F.struct(
        "ts", "event_id", "referrer_domain", "utm_source", "utm_medium",
        F.col("url_path").alias("landing_page"),
    )
    measures = [
        F.count("*").alias("events"),
        F.min("ts").alias("first_event"),
        F.max("ts").alias("last_event"),
        F.min(first).alias("first"),
    ]
    extra = []
    if with_events:
        row = F.struct("ts", "event_id", "event_type", "event_name", "url_path", "value")
        measures.append(F.sort_array(F.collect_list(row)).alias("event_list"))
        extra = ["event_list"]
    return (
        timeline.groupBy("client_id", session.alias("session_id"))
        .agg(*measures)
        .select(
            "client_id", "session_id", "events", "first_event", "last_event",
            *[
                F.col(f"first.{c}").alias(c)
                for c in ("referrer_domain", "utm_source", "utm_medium", "landing_page")
            ],
            *extra,
        )
        .orderBy("client_id", F.desc("first_event"), "session_id")
    )


def storage_report(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Bytes on disk and rows per stored table, largest first.

    Reads file metadata columns only; the row count comes from parquet footers.
    """
    parts = None
    for name, path in tables.items():
        files = (
            spark.read.parquet(path)
            .select("_metadata.file_path", "_metadata.file_size")
            .groupBy("file_path")
            .agg(F.max("file_size").alias("bytes"), F.count("*").alias("rows"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("total_rows"))
            .select(F.lit(name).alias("table"), "bytes", "total_rows")
        )
        parts = files if parts is None else parts.unionByName(files)
    if parts is None:
        raise ValueError("no tables given")
    return parts.withColumn("disk_size", text.readable_size(F.col("bytes"))).orderBy(F.desc("bytes"))
