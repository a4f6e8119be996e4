"""Daily rollups of the event table.

All counters of one rollup come from one scan with map-side combine. Exact distinct
counts use Spark's two-phase distinct aggregation, or, where one key needs several, a
first pass per visitor; both spread a dominant website over all its visitors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.schema import CHECKOUT_EVENTS


def _date() -> Column:
    return F.to_date("timestamp").alias("date")


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type



def daily_stats(events: DataFrame, with_bounces: bool = False) -> DataFrame:
    """Page views, visitors and sessions per day and website.

    `bounces` is 0 as stored by the collector; `with_bounces` counts the sessions of the
    day (by `session_id`) that have exactly one page view.
    """
    if not with_bounces:
        return events.groupBy(_date(), "website_id").agg(
            F.count_if(_is("page_view")).alias("pageviews"),
            F.count_distinct("client_id").alias("visitors"),
            F.count_distinct("session_id").alias("sessions"),
            F.lit(0).cast("long").alias("bounces"),
        )
    visits = events.groupBy(_date(), "website_id", "client_id", "session_id").agg(
        F.count_if(_is("page_view")).alias("views")
    )
    return visits.groupBy("date", "website_id").agg(
        F.sum("views").alias("pageviews"),
        F.count_distinct("client_id").alias("visitors"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(F.col("views") == 1).alias("bounces"),
    )


def _page_view_stats(events: DataFrame, *keys: str) -> DataFrame:
    return events.filter(_is("page_view")).groupBy(_date(), "website_id", *keys).agg(
        F.count("*").alias("pageviews"), F.count_distinct("client_id").alias("visitors")
    )


def page_stats(events: DataFrame) -> DataFrame:
    return _page_view_stats(events, "url_path")


def referrer_stats(events: DataFrame) -> DataFrame:
    return _page_view_stats(events, "referrer_domain", "utm_source", "utm_medium")


def device_stats(events: DataFrame) -> DataFrame:
    return _page_view_stats(events, "browser", "os", "device_type").drop("pageviews")


def country_stats(events: DataFrame) -> DataFrame:
    return _page_view_stats(events, "country")


def revenue_daily(events: DataFrame) -> DataFrame:
    """Paid purchases per day, website and currency. Refunds are not subtracted.

    `items_sold` counts item lines; `units_sold` adds up their quantities.
    """
    return (
        events.filter(_is("purchase") & (F.col("value") > 0))
        .groupBy(_date(), "website_id", "currency")
        .agg(
            F.count("*").alias("transactions"),
            F.sum("value").alias("revenue"),
            F.sum("tax").alias("tax_total"),
            F.sum("shipping").alias("shipping_total"),
            F.sum(F.size("items.item_id")).alias("items_sold"),
            _units().alias("units_sold"),
            F.count_distinct("client_id").alias("buyers"),
        )
    )


_PRODUCT = ("item_id", "item_name", "item_brand", "item_category")
_PRODUCT_EVENTS = ("view_item", "add_to_cart", "purchase")


def _item_lines(events: DataFrame, *event_types: str) -> DataFrame:
    """One row per item; `explode` with field access reads only the fields used."""
    item = F.col("item")
    return (
        events.filter(F.col("event_type").isin(*event_types) & (F.size("items") > 0))
        .select("timestamp", "website_id", "event_type", F.explode("items").alias("item"))
        .select(
            _date(), "website_id", "event_type",
            *[item[f].alias(f) for f in _PRODUCT],
            item["price"].alias("price"), item["quantity"].alias("quantity"),
        )
    )


def _product_measures(lines: DataFrame, revenue_mode: str) -> DataFrame:
    if revenue_mode not in ("unit", "extended"):
        raise ValueError("revenue_mode is 'unit' or 'extended'")
    bought = _is("purchase")
    price = F.col("price")
    revenue = price if revenue_mode == "unit" else price * F.col("quantity")
    return lines.select(
        "date", "website_id", *_PRODUCT,
        _is("view_item").cast("long").alias("views"),
        _is("add_to_cart").cast("long").alias("adds_to_cart"),
        bought.cast("long").alias("purchases"),
        F.when(bought, revenue).otherwise(F.lit(0.0)).alias("revenue"),
        F.when(bought, F.col("quantity")).otherwise(F.lit(0)).cast("long").alias("quantity_sold"),
    )


def product_views(events: DataFrame) -> DataFrame:
    """One row per viewed item, ready to be summed."""
    return _product_measures(_item_lines(events, "view_item"), "unit")


def product_carts(events: DataFrame) -> DataFrame:
    """One row per item put in a cart, ready to be summed."""
    return _product_measures(_item_lines(events, "add_to_cart"), "unit")


def product_purchases(events: DataFrame, revenue_mode: str = "unit") -> DataFrame:
    """One row per bought item; revenue is the unit price, or price x quantity."""
    return _product_measures(_item_lines(events, "purchase"), revenue_mode)


def product_stats(events: DataFrame, revenue_mode: str = "unit") -> DataFrame:
    """Views, carts, purchases and revenue per day, website and item.

    One scan serves all three event kinds. When an item carries several names on a day,
    the smallest (name, brand, category) is shown.
    """
    lines = _product_measures(_item_lines(events, *_PRODUCT_EVENTS), revenue_mode)
    label = F.struct("item_name", "item_brand", "item_category")
    sums = ("views", "adds_to_cart", "purchases", "revenue", "quantity_sold")
    # Summing per label first stays hash-based; picking the label runs on few rows.
    per_label = lines.groupBy("date", "website_id", *_PRODUCT).agg(*[F.sum(s).alias(s) for s in sums])
    return (
        per_label.groupBy("date", "website_id", "item_id")
        .agg(F.min(label).alias("label"), *[F.sum(s).alias(s) for s in sums])
        .select("date", "website_id", "item_id", "label.*", *sums)
    )


def custom_event_stats(events: DataFrame) -> DataFrame:
    return (
        events.filter(_is("custom") & (F.col("event_name") != ""))
        .groupBy(_date(), "website_id", "event_name", "event_category")
        .agg(
            F.count("*").alias("event_count"),
            F.count_distinct("client_id").alias("unique_users"),
            F.sum("event_value").alias("total_value"),
        )
    )


def ecommerce_funnel(events: DataFrame) -> DataFrame:
    """Visitors per day and website that did each shop stage, in any order."""
    stages = {
        "view_item_users": ("view_item",),
        "add_to_cart_users": ("add_to_cart",),
        "checkout_users": CHECKOUT_EVENTS,
        "purchase_users": ("purchase",),
    }
    kinds = [kind for group in stages.values() for kind in group]
    reached = {n: F.max(F.col("event_type").isin(*k).cast("int")) for n, k in stages.items()}
    visitors = (
        events.filter(F.col("event_type").isin(*kinds))
        .groupBy(_date(), "website_id", "client_id")
        .agg(*[c.alias(n) for n, c in reached.items()])
    )
    return visitors.groupBy("date", "website_id").agg(*[F.sum(n).alias(n) for n in stages])


def merge_rollups(
    parts: DataFrame, keys: Sequence[str], sums: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """Add up rollup parts with equal keys.

    Other columns (`carry`) take their smallest value; rows whose sums are all 0 vanish.
    Counters and amounts merge exactly; summed distinct counts do not, see
    `merge_sketch`.
    """
    merged = parts.groupBy(*keys).agg(
        *[F.sum(s).alias(s) for s in sums], *[F.min(c).alias(c) for c in carry]
    )
    some = F.lit(False)
    for name in sums:
        some = some | (F.col(name) != 0)
    return merged.filter(some)


def distinct_sketch(
    events: DataFrame, keys: Sequence[str] = ("website_id",), column: str = "client_id", lg_k: int = 12
) -> DataFrame:
    """HyperLogLog sketch of `column` per day and `keys`; a fixed-size, mergeable distinct."""
    return events.groupBy(_date(), *keys).agg(
        F.hll_sketch_agg(column, F.lit(lg_k)).alias("sketch")
    )


def merge_sketch(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of sketches with equal keys."""
    return parts.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_estimate(sketches: DataFrame, name: str = "visitors") -> DataFrame:
    """Replace the sketch by its estimated distinct count."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


class Spec(NamedTuple):
    """A rollup taken apart: what adds up, and what is a distinct count of which column."""

    keys: tuple[str, ...]
    rows: Callable[[], Column]
    sums: Mapping[str, Callable[[], Column]]
    distinct: Mapping[str, Callable[[], Column]]
    labels: tuple[str, ...] = ()


def _sum(name: str) -> Callable[[], Column]:
    return lambda: F.sum(name)


def _client() -> Column:
    return F.col("client_id")


def _client_if(*event_types: str) -> Callable[[], Column]:
    return lambda: F.when(F.col("event_type").isin(*event_types), F.col("client_id"))


def _view_spec(*keys: str, counted: bool = True) -> Spec:
    sums = {"pageviews": lambda: F.count("*")} if counted else {}
    return Spec(keys, lambda: _is("page_view"), sums, {"visitors": _client})


def _units() -> Column:
    return F.sum(F.aggregate("items.quantity", F.lit(0).cast("long"), lambda acc, q: acc + q))


_SHOP_KINDS = ("view_item", "add_to_cart", *CHECKOUT_EVENTS, "purchase")
SPECS = {
    "daily_stats": Spec(
        (), lambda: F.lit(True),
        {"pageviews": lambda: F.count_if(_is("page_view")), "bounces": lambda: F.sum(F.lit(0).cast("long"))},
        {"visitors": _client, "sessions": lambda: F.col("session_id")}),
    "page_stats": _view_spec("url_path"),
    "referrer_stats": _view_spec("referrer_domain", "utm_source", "utm_medium"),
    "device_stats": _view_spec("browser", "os", "device_type", counted=False),
    "country_stats": _view_spec("country"),
    "revenue_daily": Spec(
        ("currency",), lambda: _is("purchase") & (F.col("value") > 0),
        {"transactions": lambda: F.count("*"), "revenue": _sum("value"), "tax_total": _sum("tax"),
         "shipping_total": _sum("shipping"), "items_sold": lambda: F.sum(F.size("items.item_id")), "units_sold": _units},
        {"buyers": _client}),
    "product_stats": Spec(
        ("item_id",), lambda: F.lit(True),
        {n: _sum(n) for n in ("views", "adds_to_cart", "purchases", "revenue", "quantity_sold")}, {},
        ("item_name", "item_brand", "item_category")),
    "custom_event_stats": Spec(
        ("event_name", "event_category"), lambda: _is("custom") & (F.col("event_name") != ""),
        {"event_count": lambda: F.count("*"), "total_value": _sum("event_value")}, {"unique_users": _client}),
    "ecommerce_funnel": Spec(
        (), lambda: F.col("event_type").isin(*_SHOP_KINDS), {},
        {"view_item_users": _client_if("view_item"), "add_to_cart_users": _client_if("add_to_cart"),
         "checkout_users": _client_if(*CHECKOUT_EVENTS), "purchase_users": _client_if("purchase")}),
}


def countable(column: Column | str) -> Column:
    """A text as sketches count it: they pass over the empty one, so each gets a mark."""
    return F.concat(F.lit("="), column)


def sketch_part(events: DataFrame, spec: Spec, lg_k: int = 12) -> DataFrame:
    """Sums of a rollup and a mergeable sketch for each of its distinct counts."""
    return events.filter(spec.rows()).groupBy(_date(), "website_id", *spec.keys).agg(
        *[make().alias(name) for name, make in spec.sums.items()],
        *[F.hll_sketch_agg(countable(make()), F.lit(lg_k)).alias(name) for name, make in spec.distinct.items()],
    )


ROLLUPS = {
    "daily_stats": daily_stats,
    "page_stats": page_stats,
    "referrer_stats": referrer_stats,
    "device_stats": device_stats,
    "country_stats": country_stats,
    "revenue_daily": revenue_daily,
    "product_stats": product_stats,
    "custom_event_stats": custom_event_stats,
    "ecommerce_funnel": ecommerce_funnel,
}
