"""Sessions re-derived from events.

No window ever runs over the events of a visitor. Time is cut into slices as long as the
inactivity gap: two events of one slice are always closer than the gap, so a session can
only begin at the first event of a slice. Slices are built by an ordinary aggregation
(with map-side combine), the window runs over slices, whose number per visitor is bounded
by the calendar, and a visitor holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import identity, text, urls
from trailmark.schema import (
    ECOMMERCE_EVENTS,
    ECOMMERCE_FIELDS,
    INTERACTION_FIELDS,
    ITEM_TYPES,
    NUMBER_FIELDS,
    PERCENT_FIELDS,
    UTM_FIELDS,
)

VISITOR = ("website_id", "client_id")
GAP_SECONDS = 30 * 60

_KEY = ["slice_no", "slice_day"]


def _is_view() -> Column:
    return F.col("event_type") == "page_view"


def _order() -> Column:
    """Total order of events: time, then id."""
    return F.struct("timestamp", "event_id")


def _with_slice(events: DataFrame, gap_seconds: int, split_at_midnight: bool) -> DataFrame:
    micros = F.unix_micros("timestamp")
    day = F.to_date("timestamp") if split_at_midnight else F.lit(None).cast("date")
    return events.withColumns({
        "slice_no": F.floor(micros / F.lit(gap_seconds * 1_000_000)).cast("long"),
        "slice_day": F.coalesce(day, F.lit("1970-01-01").cast("date")),
    })


def session_slices(
    events: DataFrame,
    gap_seconds: int = GAP_SECONDS,
    split_at_midnight: bool = False,
    measures: Mapping[str, Column] | None = None,
    keys: Sequence[str] = VISITOR,
) -> DataFrame:
    """One row per visitor and non-empty slice, numbered by session.

    Adds `session_no` (1, 2, ... per visitor) and `slice_first`, `slice_last` times;
    `measures` are extra aggregates of the slice. A session begins when the silence
    before it is at least the gap, or at midnight when asked for.
    """
    slices = _with_slice(events, gap_seconds, split_at_midnight).groupBy(*keys, *_KEY).agg(
        F.min("timestamp").alias("slice_first"),
        F.max("timestamp").alias("slice_last"),
        *[c.alias(n) for n, c in (measures or {}).items()],
    )
    order = Window.partitionBy(*keys).orderBy("slice_first")
    silence = F.unix_micros("slice_first") - F.unix_micros(F.lag("slice_last").over(order))
    opens = F.coalesce(silence >= gap_seconds * 1_000_000, F.lit(True))
    if split_at_midnight:
        opens = opens | (F.col("slice_day") != F.lag("slice_day").over(order))
    return slices.withColumn("opens", opens.cast("int")).withColumn(
        "session_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("opens")


def sessionize(
    events: DataFrame,
    gap_seconds: int = GAP_SECONDS,
    split_at_midnight: bool = False,
    mark_first: bool = False,
    keys: Sequence[str] = VISITOR,
) -> DataFrame:
    """Events with `session_no` and `session_start`.

    `mark_first` adds `is_session_start`, true on the one event that opens the session;
    it costs a sort-based aggregation, the plain form is hash-based throughout.
    """
    measures = {"first_order": F.min(_order())} if mark_first else {}
    slices = session_slices(events, gap_seconds, split_at_midnight, measures, keys)
    per_session = Window.partitionBy(*keys, "session_no")
    first = "first_order" if mark_first else "slice_first"
    located = slices.select(
        *keys, *_KEY, "session_no", F.min(first).over(per_session).alias("session_first")
    )
    out = _with_slice(events, gap_seconds, split_at_midnight).join(located, [*keys, *_KEY])
    if mark_first:
        out = out.withColumns({
            "session_start": F.col("session_first.timestamp"),
            "is_session_start": _order() == F.col("session_first"),
        })
    else:
        out = out.withColumn("session_start", F.col("session_first"))
    return out.drop(*_KEY, "session_first")


def emit_session_starts(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """`session_start` rows for sessions that a page view opens.

    Returns the new rows only, with event ids of their own that are made from those of the
    page views; union them with the events to store them.
    """
    first = sessionize(events, gap_seconds, mark_first=True).filter(F.col("is_session_start") & _is_view())
    own_id = F.sha2(F.concat(F.lit("session_start|"), "event_id"), 256)
    return first.withColumns({"event_type": F.lit("session_start"), "event_id": own_id}).select(*events.columns)


_LANDING = ("url_path", "url_query", "referrer")


def first_touch(events: DataFrame) -> DataFrame:
    """Landing columns of the first event of each session (`first`), and its place in order."""
    return events.groupBy(*VISITOR, "session_id").agg(
        F.min_by(F.struct(*_LANDING), _order()).alias("first"), F.min(_order()).alias("first_order")
    )


def merge_touch(parts: DataFrame) -> DataFrame:
    """First touches of several lots of events (see `first_touch`) as those of all of them."""
    return parts.groupBy(*VISITOR, "session_id").agg(
        F.min_by("first", "first_order").alias("first"), F.min("first_order").alias("first_order")
    )


def session_attribution(events: DataFrame) -> DataFrame:
    """Events stamped with the first touch of their session (see `stamp_touch`)."""
    return stamp_touch(events, first_touch(events))


def stamp_touch(events: DataFrame, touches: DataFrame) -> DataFrame:
    """Events with the first touch of their session.

    Campaign columns take the value of the session's first event (with ad click ids
    applied); where that is blank, the event keeps its own. The referrer falls back to
    the session's only when the page has none. Adds the click ids and `landing_page`.
    """
    keys = [*VISITOR, "session_id"]
    first = touches.select(*keys, *[F.col(f"first.{c}").alias(f"first_{c}") for c in _LANDING])
    query = F.col("first_url_query")
    source, medium = urls.click_source(query)
    touch = first.select(
        *keys,
        source.alias("first_utm_source"),
        medium.alias("first_utm_medium"),
        *[urls.query_param(query, n).alias(f"first_{n}") for n in UTM_FIELDS[2:]],
        *[urls.query_param(query, n).alias(n) for n in urls.CLICK_SOURCES],
        urls.query_param(query, "gad_campaignid").alias("gad_campaignid"),
        F.concat("first_url_path", "first_url_query").alias("landing_page"),
        "first_referrer",
    )
    stamped = {n: text.first_filled(F.col(f"first_{n}"), F.col(n)) for n in UTM_FIELDS}
    stamped["referrer"] = text.first_filled(F.col("referrer"), F.col("first_referrer"))
    return (
        events.join(touch, keys)
        .withColumns(stamped)
        .drop("first_referrer", *[f"first_{n}" for n in UTM_FIELDS])
    )


def previous_value(
    events: DataFrame, value: Column, keys: Sequence[str], name: str, slice_seconds: int = 60
) -> DataFrame:
    """`lag(value)` per key in time order, safe for a key with any number of rows.

    Rows are windowed within one short time slice of their key; only the first row of a slice
    needs the last value of the slice before it, which comes from slice summaries. A task
    holds the rows of a key's slice or one summary per slice of the key.
    """
    sliced = events.withColumns({
        "lag_value": value,
        "lag_slice": F.floor(F.unix_micros("timestamp") / F.lit(slice_seconds * 1_000_000)).cast("long"),
    })
    order = Window.partitionBy(*keys).orderBy("lag_slice")
    carried = (
        sliced.groupBy(*keys, "lag_slice")
        .agg(F.max_by("lag_value", _order()).alias("last_value"))
        .select(*keys, "lag_slice", F.lag("last_value").over(order).alias("carried_value"))
    )
    within = Window.partitionBy(*keys, "lag_slice").orderBy("timestamp", "event_id")
    return (
        sliced.withColumn("within_value", F.lag("lag_value").over(within))
        .join(carried, [*keys, "lag_slice"])
        .withColumn(name, F.coalesce("within_value", "carried_value"))
        .drop("lag_value", "lag_slice", "within_value", "carried_value")
    )


def dedupe_navigation(events: DataFrame) -> DataFrame:
    """Page views whose path and query differ from the page view before it in the session."""
    address = F.concat("url_path", "url_query")
    views = previous_value(
        events.filter(_is_view()), address, [*VISITOR, "session_id"], "previous_address"
    )
    changed = ~address.eqNullSafe(F.col("previous_address"))
    return views.filter(changed).drop("previous_address")


def hash_session_id(requests: DataFrame) -> DataFrame:
    """Add `cookieless_id` from `website_id, host, ip, user_agent, timestamp`."""
    return requests.withColumn(
        "cookieless_id",
        identity.cookieless_id(
            F.col("website_id"), F.col("host"), F.col("ip"), F.col("user_agent"), F.col("timestamp")
        ),
    )


def route_event_type(calls: DataFrame) -> DataFrame:
    """Event type of an API call by its `event_name`: a shop event or `custom`."""
    name = F.col("event_name")
    return calls.withColumn(
        "event_type", F.when(name.isin(*ECOMMERCE_EVENTS), name).otherwise(F.lit("custom"))
    )


_KNOWN = tuple(dict.fromkeys(ECOMMERCE_FIELDS + INTERACTION_FIELDS))


def split_known_fields(calls: DataFrame, data: str = "data") -> DataFrame:
    """Known keys of the `data` map as columns (NULL when absent), the rest as `properties`."""
    source = F.col(data)

    def typed(name: str) -> Column:
        value = F.try_element_at(source, F.lit(name))
        if name in NUMBER_FIELDS:
            return text.float_prefix(value)
        if name in PERCENT_FIELDS:
            return text.percent(value)
        return value

    return calls.withColumns({
        **{name: typed(name) for name in _KNOWN},
        "properties": F.map_filter(source, lambda key, _: ~key.isin(*_KNOWN)),
    })


# Item keys of the older tag format.
_ITEM_ALIASES = {
    "item_id": "id", "item_name": "name", "item_brand": "brand", "item_category": "category",
    "item_variant": "variant",
}
_ENTRY_TEXTS = (
    "transaction_id", "affiliation", "currency", "coupon", "payment_type", "shipping_tier",
    "item_list_name", "item_list_id",
)
_ENTRY_NUMBERS = ("value", "tax", "shipping")


def normalize_datalayer(entries: DataFrame, column: str = "entry") -> DataFrame:
    """Tag-manager entries (JSON text) as shop event columns with typed items.

    Only shop events pass. Fields come from `ecommerce` when present, else from the entry.
    A missing or zero quantity counts as 1.
    """
    doc = F.col("entry_doc")
    shop = F.coalesce(
        F.when(~F.is_variant_null(F.try_variant_get(doc, "$.ecommerce", "variant")),
               F.try_variant_get(doc, "$.ecommerce", "variant")),
        doc,
    )

    def get(source: Column, name: str) -> Column:
        return F.try_variant_get(source, f"$.{name}", "string")

    def item(entry: Column) -> Column:
        fields = []
        for name, kind in ITEM_TYPES.items():
            raw = get(entry, name)
            if name in _ITEM_ALIASES:
                value = text.first_filled(raw, get(entry, _ITEM_ALIASES[name]))
            elif kind.typeName() == "string":
                value = text.first_filled(raw)
            elif kind.typeName() == "double":
                value = F.coalesce(text.float_prefix(raw), F.lit(0.0))
            else:
                value = text.int_prefix(raw).try_cast("long")
            if name == "quantity":
                value = F.when(value != 0, value).otherwise(F.lit(1).cast("long"))
            fields.append(value.alias(name))
        return F.struct(*fields)

    items = F.transform(F.try_variant_get(F.col("shop"), "$.items", "array<variant>"), item)
    columns = {n: text.first_filled(get(F.col("shop"), n)) for n in _ENTRY_TEXTS}
    columns |= {
        n: F.coalesce(text.float_prefix(get(F.col("shop"), n)), F.lit(0.0)) for n in _ENTRY_NUMBERS
    }
    return (
        entries.withColumn("entry_doc", F.try_parse_json(F.col(column)))
        .withColumn("event_type", get(doc, "event"))
        .filter(F.col("event_type").isin(*ECOMMERCE_EVENTS))
        .withColumn("event_name", F.col("event_type"))
        .withColumn("shop", shop)
        .withColumns({**columns, "items": items})
        .drop("entry_doc", "shop")
    )


_TOUCH = (
    "url_path", "url_query", "referrer_domain", "utm_source", "utm_medium", "utm_campaign",
)


def session_table(
    events: DataFrame, gap_seconds: int = GAP_SECONDS, split_at_midnight: bool = False
) -> DataFrame:
    """One row per session: time span, counts, entry and exit page, first touch.

    Built from slices alone, so the events are shuffled once, already combined.
    """
    view = F.when(_is_view(), F.struct("timestamp", "event_id", "url_path"))
    measures = {
        "events": F.count("*"),
        "pageviews": F.count_if(_is_view()),
        "purchases": F.count_if(F.col("event_type") == "purchase"),
        "revenue": F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)),
        "first": F.min(F.struct("timestamp", "event_id", *_TOUCH)),
        "entry": F.min(view),
        "leave": F.max(view),
    }
    slices = session_slices(events, gap_seconds, split_at_midnight, measures)
    seconds = F.unix_seconds("ended_at") - F.unix_seconds("started_at")
    return (
        slices.groupBy(*VISITOR, "session_no")
        .agg(
            F.min("slice_first").alias("started_at"),
            F.max("slice_last").alias("ended_at"),
            F.sum("events").alias("events"),
            F.sum("pageviews").alias("pageviews"),
            F.sum("purchases").alias("purchases"),
            F.sum("revenue").alias("revenue"),
            F.min("first").alias("first"),
            F.min("entry").alias("entry"),
            F.max("leave").alias("leave"),
        )
        .select(
            *VISITOR, "session_no", "started_at", "ended_at",
            seconds.alias("duration_seconds"), "events", "pageviews", "purchases", "revenue",
            F.coalesce("entry.url_path", F.lit("")).alias("entry_page"),
            F.coalesce("leave.url_path", F.lit("")).alias("exit_page"),
            *[F.col(f"first.{c}").alias(f"first_{c}") for c in _TOUCH],
        )
    )


def bounce_rate(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Per website: sessions, bounced sessions (exactly one page view) and their share."""
    bounced = F.count_if(F.col("pageviews") == 1)
    return session_table(events, gap_seconds).groupBy("website_id").agg(
        F.count("*").alias("sessions"),
        bounced.alias("bounces"),
        (bounced / F.count("*")).alias("bounce_rate"),
    )
