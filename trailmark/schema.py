"""Event model: column types, accepted event names and field limits."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names and limits that stored results depend on.
# ---------------------------------------------------------------------------

STANDARD_EVENTS = ("page_view", "session_start", "scroll", "click", "web_vital", "custom")

ECOMMERCE_EVENTS = (
    "view_item_list", "select_item", "view_item", "add_to_wishlist", "add_to_cart",
    "remove_from_cart", "view_cart", "begin_checkout", "add_shipping_info",
    "add_payment_info", "purchase", "refund", "view_promotion", "select_promotion",
)

ENGAGEMENT_EVENTS = (
    "search", "share", "sign_up", "login", "generate_lead", "form_submit",
    "file_download", "video_start", "video_progress", "video_complete",
)

EVENT_TYPES = STANDARD_EVENTS + ECOMMERCE_EVENTS + ENGAGEMENT_EVENTS

CHECKOUT_EVENTS = ("begin_checkout", "add_payment_info", "add_shipping_info")

MAX_TEXT = 500
MAX_ITEMS = 200
MAX_PROPERTIES = 50

# String fields of a payload with the number of characters that are kept.
TEXT_LIMITS = {
    "event_name": MAX_TEXT,
    "client_id": 64,
    "session_id": 64,
    "url_path": MAX_TEXT,
    "url_query": MAX_TEXT,
    "page_title": MAX_TEXT,
    "referrer": MAX_TEXT,
    "screen": 20,
    "language": 20,
    "utm_source": 100,
    "utm_medium": 100,
    "utm_campaign": MAX_TEXT,
    "utm_term": MAX_TEXT,
    "utm_content": MAX_TEXT,
    "transaction_id": MAX_TEXT,
    "affiliation": MAX_TEXT,
    "currency": 10,
    "coupon": MAX_TEXT,
    "payment_type": 100,
    "shipping_tier": 100,
    "item_list_id": MAX_TEXT,
    "item_list_name": MAX_TEXT,
    "creative_name": MAX_TEXT,
    "creative_slot": MAX_TEXT,
    "promotion_id": MAX_TEXT,
    "promotion_name": MAX_TEXT,
    "event_category": 100,
    "event_label": MAX_TEXT,
    "click_element": MAX_TEXT,
    "click_text": MAX_TEXT,
    "click_url": MAX_TEXT,
    "click_classes": MAX_TEXT,
    "click_id": 100,
    "form_id": 100,
    "form_name": MAX_TEXT,
    "form_destination": MAX_TEXT,
    "video_provider": 50,
    "video_title": MAX_TEXT,
    "video_url": MAX_TEXT,
    "file_name": MAX_TEXT,
    "file_extension": 20,
    "search_term": MAX_TEXT,
}

NUMBER_FIELDS = (
    "value", "tax", "shipping", "event_value", "video_duration",
    "lcp_value", "fid_value", "cls_value", "inp_value",
)

PERCENT_FIELDS = ("scroll_depth", "video_percent")

# Known keys of an API call that become columns; every other key is a property.
ECOMMERCE_FIELDS = (
    "transaction_id", "affiliation", "currency", "value", "tax", "shipping", "coupon",
    "payment_type", "shipping_tier", "item_list_id", "item_list_name", "items",
    "creative_name", "creative_slot", "promotion_id", "promotion_name",
)

INTERACTION_FIELDS = (
    "event_category", "event_label", "event_value", "click_element", "click_text",
    "click_url", "click_id", "click_classes", "scroll_depth", "form_id", "form_name",
    "form_destination", "video_provider", "video_title", "video_url", "video_duration",
    "video_percent", "file_name", "file_extension", "search_term", "lcp_value",
    "fid_value", "cls_value", "inp_value",
)

UTM_FIELDS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")

# ---------------------------------------------------------------------------
# Types
# ---------------------------------------------------------------------------

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

ITEM_TYPES = {
    "item_id": _S, "item_name": _S, "affiliation": _S, "coupon": _S, "discount": _D,
    "index": _L, "item_brand": _S, "item_category": _S, "item_category2": _S,
    "item_category3": _S, "item_category4": _S, "item_category5": _S,
    "item_list_id": _S, "item_list_name": _S, "item_variant": _S, "location_id": _S,
    "price": _D, "quantity": _L,
}
ITEM_STRUCT = T.StructType([T.StructField(n, t) for n, t in ITEM_TYPES.items()])


def _text(*names: str) -> list[tuple[str, T.DataType]]:
    return [(n, _S) for n in names]


def _number(*names: str) -> list[tuple[str, T.DataType]]:
    return [(n, _D) for n in names]


_COLUMNS: list[tuple[str, T.DataType]] = [
    ("timestamp", T.TimestampType()),
    *_text("event_type", "event_name", "website_id", "client_id", "session_id"),
    *_text("url_path", "url_query", "page_title"),
    *_text("referrer", "referrer_domain", *UTM_FIELDS),
    *_text("country", "city"),
    *_text("browser", "browser_version", "os", "device_type", "screen", "language"),
    *_text("transaction_id", "affiliation", "currency"),
    *_number("value", "tax", "shipping"),
    *_text("coupon", "payment_type", "shipping_tier", "item_list_id", "item_list_name"),
    *_text("creative_name", "creative_slot", "promotion_id", "promotion_name"),
    ("items", T.ArrayType(ITEM_STRUCT)),
    *_text("event_category", "event_label"),
    *_number("event_value"),
    ("properties", T.MapType(_S, _S)),
    *_text("click_element", "click_text", "click_url", "click_classes", "click_id"),
    ("scroll_depth", T.ShortType()),
    *_text("form_id", "form_name", "form_destination"),
    *_text("video_provider", "video_title", "video_url"),
    *_number("video_duration"),
    ("video_percent", T.ShortType()),
    *_text("file_name", "file_extension", "search_term"),
    *_number("lcp_value", "fid_value", "cls_value", "inp_value"),
]

EVENTS_SCHEMA = T.StructType([T.StructField(n, t) for n, t in _COLUMNS])

# `event_id` orders events of the same second; `ingest_time` is the server clock.
LINEAGE_COLUMNS = ("event_id", "ingest_time")

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("body", _S),
    T.StructField("ip", _S),
    T.StructField("user_agent", _S),
    T.StructField("ingest_time", T.TimestampType()),
])

RAW_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    *[T.StructField(n, _S) for n in ("website_id", "payload", "ip_hash", "user_agent")],
])

BAD_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    *[T.StructField(n, _S) for n in ("website_id", "payload", "reason", "ip_hash", "user_agent")],
])
