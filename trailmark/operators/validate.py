"""Payload validation: JSON text in, typed event columns or a reject reason out.

Input rows carry `body, ip, user_agent, ingest_time`. Everything here is a projection:
no shuffle, so a backfill runs at scan speed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import schema
from trailmark.functions import identity, text

INVALID_BODY = "invalid_body"
MISSING_WEBSITE = "missing_website_id"
MISSING_TYPE = "missing_event_type"
INVALID_TYPE = "invalid_event_type"
UNKNOWN_WEBSITE = "unknown_website"

_ISO_TIME = (
    r"^\d{4}(?:-\d\d(?:-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:[.]\d+)?)?\s*(?:Z|[+-]\d\d:?\d\d)?)?)?)?$"
)


# Fields whose JSON type matters; all others are read as text.
_TYPED_FIELDS = ("website_id", "event_type", "timestamp", "items")
_TEXT_FIELDS = (
    *schema.TEXT_LIMITS, *schema.NUMBER_FIELDS, *schema.PERCENT_FIELDS, "properties",
)
_REQUIRED_FIELDS = ("website_id", "event_type")
_CORRUPT = "_corrupt_record"
_MARK = "_end_of_body"
_STRICT_JSON = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": _CORRUPT,
}


def parse_body(payloads: DataFrame, fields: tuple[str, ...] = _TYPED_FIELDS + _TEXT_FIELDS) -> DataFrame:
    """Add `doc`, a struct of the wanted body fields.

    The struct comes out of a generator, which Catalyst does not fold into the many
    expressions that read it: each body is parsed once per row. The body is read as the first
    of two array elements, the second being a mark made from the body itself, so text behind
    the object makes it unreadable (`doc` is NULL).
    """
    columns = [f"{n}: {'VARIANT' if n in _TYPED_FIELDS else 'STRING'}" for n in fields]
    layout = f"array<struct<{', '.join(columns)}, {_CORRUPT}: STRING, {_MARK}: STRING>>"
    mark = F.sha2("body", 256)
    marked = F.concat(F.lit("["), F.col("body"), F.lit(f',{{"{_MARK}":"'), mark, F.lit('"}]'))
    parsed = F.from_json(marked, layout, _STRICT_JSON)
    read = payloads.select("*", F.explode(F.array(parsed)).alias("_read"))
    whole = (F.size("_read") == 2) & (F.try_element_at("_read", F.lit(2))[_MARK] == mark)
    return read.withColumn("doc", F.when(whole, F.try_element_at("_read", F.lit(1)))).drop("_read")


def _missing(field: Column) -> Column:
    """True unless the field is a JSON string with a visible character."""
    is_text = F.schema_of_variant(field) == "STRING"
    visible = F.try_variant_get(field, "$", "string").rlike(r"(?U)[^\s\uFEFF]")
    return ~F.coalesce(is_text & visible, F.lit(False))


def reject_reason(body: Column, doc: Column) -> Column:
    """Why a body is refused, first failing rule wins; NULL for a good one.

    An array is an object without fields.
    """
    is_object = body.rlike(r"^\s*[{]") & doc.isNotNull() & doc[_CORRUPT].isNull()
    mark = F.sha2(body, 256)
    marked = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), mark, F.lit('"]')))
    whole = (F.try_variant_get(marked, "$[1]", "string") == mark) & F.try_variant_get(marked, "$[2]", "variant").isNull()
    is_array = body.rlike(r"^\s*[\[]") & whole
    event_type = F.try_variant_get(doc["event_type"], "$", "string")
    return (
        F.when(F.coalesce(is_array, F.lit(False)), MISSING_WEBSITE)
        .when(~F.coalesce(is_object, F.lit(False)), INVALID_BODY)
        .when(_missing(doc["website_id"]), MISSING_WEBSITE)
        .when(_missing(doc["event_type"]), MISSING_TYPE)
        .when(~event_type.isin(*schema.EVENT_TYPES), INVALID_TYPE)
    )


def validate(payloads: DataFrame, fields: tuple[str, ...] = _TYPED_FIELDS + _TEXT_FIELDS) -> DataFrame:
    """Payloads with `doc` and `reason` (NULL for good rows)."""
    return parse_body(payloads, fields).withColumn(
        "reason", reject_reason(F.col("body"), F.col("doc"))
    )


def split_good_bad(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) halves of the payloads; each half is planned on its own."""
    good = validate(payloads).filter(F.col("reason").isNull())
    bad = validate(payloads, _REQUIRED_FIELDS).filter(F.col("reason").isNotNull())
    return good, bad


def event_time(sent: Column, ingest_time: Column) -> Column:
    """Client time in UTC, cut to seconds; the ingest time when absent or unreadable.

    ISO texts honour their offset; a JSON number is epoch milliseconds.
    """
    kind = F.schema_of_variant(sent)
    value = F.try_variant_get(sent, "$", "string")
    is_number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    millis = F.try_variant_get(sent, "$", "bigint")
    parsed = F.when(
        (kind == "STRING") & value.rlike(_ISO_TIME), value.try_cast("timestamp")
    ).when(is_number & (millis != 0), F.timestamp_millis(millis))
    return F.date_trunc("second", F.coalesce(parsed, ingest_time))


_ITEM_LAYOUT = f"struct<{', '.join(f'{n}: STRING' for n in schema.ITEM_TYPES)}>"


def parse_items(items: Column) -> Column:
    """VARIANT `items` as an array of structs: the first 200 entries, then only the objects."""
    entries = F.slice(F.try_variant_get(items, "$", "array<variant>"), 1, schema.MAX_ITEMS)
    objects = F.filter(entries, lambda e: F.schema_of_variant(e).rlike("^(?:OBJECT|ARRAY)"))
    texts = F.transform(objects, lambda e: F.try_variant_get(e, "$", _ITEM_LAYOUT))

    def typed(item: Column) -> Column:
        fields = []
        for name, kind in schema.ITEM_TYPES.items():
            if kind.typeName() == "string":
                value = text.clip(item[name], schema.MAX_TEXT)
            elif kind.typeName() == "double":
                value = text.float_prefix(item[name])
            else:
                value = text.count_number(item[name])
            fields.append(value.alias(name))
        return F.struct(*fields)

    none = F.array().cast(schema.EVENTS_SCHEMA["items"].dataType)
    return F.coalesce(F.transform(texts, typed), none)


def parse_properties(source: Column) -> Column:
    """JSON text of `properties` as a map: first 50 keys, then NULLs dropped.

    A repeated key keeps its first place and its last value. Anything but a JSON object
    gives an empty map.
    """
    entries = F.map_entries(F.from_json(source, "map<string,variant>", _STRICT_JSON))
    names = F.transform(entries, lambda e: e["key"])
    distinct = F.array_distinct(names)

    def last_value(name: Column) -> Column:
        matches = F.filter(entries, lambda e: e["key"] == name)
        return F.struct(name.alias("key"), F.element_at(matches, -1)["value"].alias("value"))

    unique = F.when(F.size(distinct) == F.size(names), entries).otherwise(
        F.transform(distinct, last_value)
    )

    def to_text(entry: Column) -> Column:
        shown = F.when(
            F.schema_of_variant(entry["value"]).startswith("OBJECT"), "[object Object]"
        ).otherwise(F.try_variant_get(entry["value"], "$", "string"))
        return F.struct(
            entry["key"].alias("key"), F.left(shown, F.lit(schema.MAX_TEXT)).alias("value")
        )

    kept = F.transform(F.slice(unique, 1, schema.MAX_PROPERTIES), to_text)
    present = F.filter(kept, lambda e: e["value"].isNotNull())
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(F.map_from_entries(present), none)


def with_ip_hash(requests: DataFrame) -> DataFrame:
    """Add `ip_hash` unless the rows come from the raw store and have it already."""
    if "ip_hash" in requests.columns:
        return requests
    return requests.withColumn("ip_hash", identity.hash_ip(F.col("ip"), F.col("ingest_time")))


def event_id() -> Column:
    """Same request, same id: replays and retries can be told from new events.

    Uses only what the raw store keeps, so a replay arrives at the same ids.
    """
    second = F.date_format("ingest_time", "yyyy-MM-dd HH:mm:ss")
    return F.sha2(F.concat_ws("|", "body", "ip_hash", second), 256)


def parse_events(good: DataFrame, *keep: str) -> DataFrame:
    """Typed event columns of validated rows (see `validate`), before enrichment.

    Request columns (`body, ip, ip_hash, user_agent, ingest_time`) and those named in `keep`
    stay for later steps.
    """
    doc = F.col("doc")
    columns = [
        event_id().alias("event_id"),
        event_time(doc["timestamp"], F.col("ingest_time")).alias("timestamp"),
        F.left(F.try_variant_get(doc["website_id"], "$", "string"), F.lit(64)).alias("website_id"),
        F.try_variant_get(doc["event_type"], "$", "string").alias("event_type"),
    ]
    columns += [text.clip(doc[n], limit).alias(n) for n, limit in schema.TEXT_LIMITS.items()]
    columns += [text.float_prefix(doc[n]).alias(n) for n in schema.NUMBER_FIELDS]
    columns += [text.percent(doc[n]).alias(n) for n in schema.PERCENT_FIELDS]
    columns += [
        parse_items(doc["items"]).alias("items"),
        parse_properties(doc["properties"]).alias("properties"),
    ]
    return with_ip_hash(good).select(
        "body", "ip", "ip_hash", "user_agent", "ingest_time", *keep, *columns
    )


def sent_website() -> Column:
    """The website a body names, unclipped; empty without one."""
    return F.coalesce(F.try_variant_get("doc.website_id", "$", "string"), F.lit(""))


def to_bad(rejected: DataFrame) -> DataFrame:
    """Dead-letter rows of rejected payloads (see `validate`).

    They bring `doc`, or `sent_website` when it was read from it before.
    """
    site = F.col("sent_website") if "sent_website" in rejected.columns else sent_website()
    body = F.col("body")
    blank = body.isNull() | body.rlike(r'^\s*(?:null|false|-?0(?:[.]0+)?|"")?\s*$')
    return with_ip_hash(rejected).select(
        F.date_trunc("second", "ingest_time").alias("timestamp"),
        site.alias("website_id"),
        F.when(blank, F.lit("{}")).otherwise(body).alias("payload"),
        F.col("reason"),
        "ip_hash",
        F.coalesce("user_agent", F.lit("")).alias("user_agent"),
    )


def to_raw(events: DataFrame) -> DataFrame:
    """Verbatim payload of each accepted event (see `parse_events`)."""
    return events.select(
        F.date_trunc("second", "ingest_time").alias("timestamp"),
        "website_id",
        F.col("body").alias("payload"),
        "ip_hash",
        F.coalesce("user_agent", F.lit("")).alias("user_agent"),
    )


def bad_event_reasons(bad: DataFrame) -> DataFrame:
    """Rejected rows per website, reason and hour."""
    return bad.groupBy(
        "website_id", "reason", F.date_trunc("hour", "timestamp").alias("hour")
    ).agg(F.count("*").alias("bad_events"))


def filter_registered(
    events: DataFrame, websites: DataFrame, id_column: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(known, unknown) events by the website register.

    The register is left unhinted: its file size lets Catalyst broadcast it while it is
    small, and adaptive execution splits a hot website otherwise.
    """
    known = websites.select(F.col(id_column).cast("string").alias("website_id")).distinct()
    return (
        events.join(known, "website_id", "left_semi"),
        events.join(known, "website_id", "left_anti").withColumn("reason", F.lit(UNKNOWN_WEBSITE)),
    )


def resolve_api_keys(requests: DataFrame, keys: DataFrame, websites: DataFrame) -> DataFrame:
    """Requests with the website their active API key (`key`) belongs to."""
    active = keys.filter("is_active").select(
        "key", F.col("website_id").cast("string").alias("website_id")
    )
    sites = websites.select(
        F.col("id").cast("string").alias("website_id"), "domain", F.col("name").alias("website_name")
    )
    return requests.join(active.join(sites, "website_id"), "key")


def api_key_last_used(requests: DataFrame) -> DataFrame:
    """Latest use per API key, from resolved requests."""
    return requests.groupBy("key").agg(F.max("timestamp").alias("last_used_at"))
