"""ANSI SQL equivalents of the registered queries, for checking on another engine.

They share only the sample columns with the Spark side (`sources.samples`); every result
is computed here on its own, in plain SQL over the raw tables.
"""

from __future__ import annotations

from trailmark.operators.reports import COVERAGE_TEXTS, DETAIL_COLUMNS, DETAIL_INTERACTION, DETAIL_ITEMS
from trailmark.schema import (
    CHECKOUT_EVENTS, EVENT_TYPES, EVENTS_SCHEMA, MAX_TEXT, NUMBER_FIELDS, PERCENT_FIELDS, TEXT_LIMITS,
)
from trailmark.sources import samples

ORACLES: dict[str, str] = {}

_BASE = """base AS (
  SELECT event_id, ts, user_id, event_type AS src_type, value AS amount,
         CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def _line(n: int) -> str:
    return "{" + ", ".join(f"'{f}': {e.format(n=n)}" for f, e in samples.WEB_ITEM.items()) + "}"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {'ts' if n == 'timestamp' else n}" for n, e in columns.items())


_WEB = f"""{_BASE}, web AS (
  SELECT {_select(samples.WEB)},
    CASE WHEN {samples.HAS_ITEMS} THEN CASE WHEN k % 2 = 0 THEN [{_line(1)}] ELSE [{_line(1)}, {_line(2)}] END
         ELSE [] END AS items,
    CASE WHEN {samples.HAS_PROPERTIES} THEN CAST(k AS VARCHAR) ELSE '' END AS plan
  FROM base)"""

_PAY = f"{_BASE}, pay AS (SELECT {_select(samples.PAYLOADS)} FROM base)"

_SHOP = f"""lines AS (
  SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS item_id, p_name AS item_name, p_brand AS item_brand,
         p_type AS item_category, p_retailprice AS price, CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem JOIN part ON p_partkey = l_partkey),
shop AS (SELECT {_select(samples.SHOP)} FROM orders)"""

DAY = "CAST(ts AS DATE)"


def _time(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def _local(expr: str = "ts") -> str:
    return f"(timezone('Europe/Istanbul', timezone('UTC', {expr})))"


def _add(cte: str, name: str, sql: str) -> None:
    ORACLES[name] = f"WITH {cte}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"


def _web(name: str, sql: str) -> None:
    _add(_WEB, name, sql)


def _pay(name: str, sql: str) -> None:
    _add(_PAY, name, sql)


def _shop(name: str, sql: str) -> None:
    _add(_SHOP, name, sql)


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


VIEW = "event_type = 'page_view'"
LATEST = "(SELECT max(ts) FROM web)"

# --- rollups ---------------------------------------------------------------

_DAILY = f"""SELECT {DAY} AS date, website_id, {_n(VIEW)} AS pageviews, count(DISTINCT client_id) AS visitors,
  count(DISTINCT session_id) AS sessions, CAST(0 AS BIGINT) AS bounces FROM web"""
_web("daily_stats", f"{_DAILY} GROUP BY ALL")
_web("daily_stats_bounces", f"""+ v AS (
  SELECT {DAY} AS date, website_id, client_id, session_id, {_n(VIEW)} AS views FROM web GROUP BY ALL)
SELECT date, website_id, CAST(sum(views) AS BIGINT) AS pageviews, count(DISTINCT client_id) AS visitors,
  count(DISTINCT session_id) AS sessions, {_n('views = 1')} AS bounces FROM v GROUP BY ALL""")
for _name, _keys in {
    "page_stats": "url_path",
    "referrer_stats": "referrer_domain, utm_source, utm_medium",
    "country_stats": "country",
}.items():
    _web(_name, f"""SELECT {DAY} AS date, website_id, {_keys}, count(*) AS pageviews,
  count(DISTINCT client_id) AS visitors FROM web WHERE {VIEW} GROUP BY ALL""")
_web("device_stats", f"""SELECT {DAY} AS date, website_id, browser, os, device_type,
  count(DISTINCT client_id) AS visitors FROM web WHERE {VIEW} GROUP BY ALL""")
_shop("revenue_daily", f"""+ n AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(quantity) AS units FROM lines GROUP BY ALL)
SELECT {DAY} AS date, website_id, currency, count(*) AS transactions, round(sum(value), 4) AS revenue,
  round(sum(tax), 4) AS tax_total, round(sum(shipping), 4) AS shipping_total,
  CAST(sum(coalesce(n_lines, 0)) AS BIGINT) AS items_sold, CAST(sum(coalesce(units, 0)) AS BIGINT) AS units_sold,
  count(DISTINCT client_id) AS buyers
FROM shop LEFT JOIN n ON l_orderkey = event_id WHERE event_type = 'purchase' AND value > 0 GROUP BY ALL""")
_web("revenue_daily_web", f"""SELECT {DAY} AS date, website_id, currency, count(*) AS transactions,
  round(sum(value), 4) AS revenue, round(sum(tax), 4) AS tax_total, round(sum(shipping), 4) AS shipping_total,
  CAST(sum(len(items)) AS BIGINT) AS items_sold,
  CAST(sum(list_sum(list_transform(items, lambda i: i.quantity))) AS BIGINT) AS units_sold,
  count(DISTINCT client_id) AS buyers
FROM web WHERE event_type = 'purchase' AND value > 0 GROUP BY ALL""")


def _product(kinds: str, extra: str = "", revenue: str = "price") -> str:
    bought = "event_type = 'purchase'"
    return f"""SELECT {DAY} AS date, website_id, item_id, {extra}
  {_n("event_type = 'view_item'")} AS views, {_n("event_type = 'add_to_cart'")} AS adds_to_cart,
  {_n(bought)} AS purchases, round(sum(CASE WHEN {bought} THEN {revenue} ELSE 0.0 END), 4) AS revenue,
  CAST(sum(CASE WHEN {bought} THEN quantity ELSE 0 END) AS BIGINT) AS quantity_sold
FROM shop JOIN lines ON l_orderkey = event_id WHERE event_type IN ({kinds}) GROUP BY {DAY}, website_id, item_id"""


_ALL_KINDS = "'view_item', 'add_to_cart', 'purchase'"
_LABELS = "min(item_name) AS item_name, min(item_brand) AS item_brand, min(item_category) AS item_category,"
_shop("product_views", _product("'view_item'"))
_shop("product_carts", _product("'add_to_cart'"))
_shop("product_purchases", _product("'purchase'"))
_shop("product_stats", _product(_ALL_KINDS, _LABELS))
_shop("product_stats_extended", _product(_ALL_KINDS, _LABELS, "price * quantity"))
_web("custom_event_stats", f"""SELECT {DAY} AS date, website_id, event_name, event_category,
  count(*) AS event_count, count(DISTINCT client_id) AS unique_users, round(sum(event_value), 4) AS total_value
FROM web WHERE event_type = 'custom' AND event_name <> '' GROUP BY ALL""")
_CHECKOUT = ", ".join(f"'{t}'" for t in CHECKOUT_EVENTS)
_web("ecommerce_funnel", f"""SELECT {DAY} AS date, website_id,
  count(DISTINCT CASE WHEN event_type = 'view_item' THEN client_id END) AS view_item_users,
  count(DISTINCT CASE WHEN event_type = 'add_to_cart' THEN client_id END) AS add_to_cart_users,
  count(DISTINCT CASE WHEN event_type IN ({_CHECKOUT}) THEN client_id END) AS checkout_users,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN client_id END) AS purchase_users
FROM web WHERE event_type IN ('view_item', 'add_to_cart', 'purchase', {_CHECKOUT}) GROUP BY ALL""")
_web("merge_rollups", f"""+ h AS (
  SELECT date_trunc('hour', ts) AS hour, website_id, url_path, count(*) AS pv,
    count(DISTINCT client_id) AS uv FROM web WHERE {VIEW} GROUP BY ALL)
SELECT CAST(hour AS DATE) AS date, website_id, url_path, CAST(sum(pv) AS BIGINT) AS pageviews,
  CAST(sum(uv) AS BIGINT) AS visitors FROM h GROUP BY ALL""")
_web("distinct_sketch", f"""SELECT {DAY} AS date, website_id, count(DISTINCT client_id) AS visitors
FROM web GROUP BY ALL""")
_web("merge_sketch", "SELECT website_id, count(DISTINCT client_id) AS visitors FROM web GROUP BY ALL")

# --- reports ---------------------------------------------------------------

_web("sites_overview", f"""SELECT website_id, count(*) AS total_events, {_n(VIEW)} AS pageviews,
  count(DISTINCT client_id) AS unique_visitors, count(DISTINCT session_id) AS sessions,
  {_time('min(ts)')} AS first_event, {_time('max(ts)')} AS last_event,
  {_n(f"ts >= {LATEST} - INTERVAL 1 HOUR")} AS events_last_hour,
  {_n(f"ts >= {LATEST} - INTERVAL 24 HOUR")} AS events_last_24h,
  {_n(f"ts >= {LATEST} - INTERVAL 5 MINUTE")} AS events_last_5min,
  count(DISTINCT CASE WHEN ts >= {LATEST} - INTERVAL 30 MINUTE THEN client_id END) AS visitors_last_30min,
  {_n(f"ts >= {LATEST} - INTERVAL 30 MINUTE")} AS events_last_30min
FROM web GROUP BY website_id""")
_web("site_stats", f"""SELECT website_id, count(*) AS total_events, {_n(VIEW)} AS pageviews,
  {_n("event_type = 'session_start'")} AS session_starts, {_n("event_type = 'scroll'")} AS scrolls,
  {_n("event_type = 'custom'")} AS custom_events, {_n("event_type = 'purchase'")} AS purchases,
  {_n("event_type = 'add_to_cart'")} AS add_to_carts, {_n("event_type = 'view_item'")} AS view_items,
  count(DISTINCT client_id) AS unique_visitors, count(DISTINCT session_id) AS sessions,
  {_time('min(ts)')} AS first_event, {_time('max(ts)')} AS last_event
FROM web WHERE ts >= {LATEST} - INTERVAL 48 HOUR GROUP BY website_id""")
_RANKED = """+ r AS (
  SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY ts DESC, event_id DESC) AS position FROM web)"""
_web("recent_events", f"""{_RANKED}
SELECT website_id, position, {_time(_local())} AS ts, event_type, event_name, url_path, browser, os, device_type,
  referrer_domain, country, city, left(client_id, 8) AS client_short, left(session_id, 8) AS session_short
FROM r WHERE position <= 50""")
_web("hourly_breakdown", f"""SELECT website_id, {_time(f"date_trunc('hour', {_local()})")} AS hour,
  count(*) AS events, count(DISTINCT client_id) AS visitors, {_n(VIEW)} AS pageviews
FROM web WHERE ts >= {LATEST} - INTERVAL 48 HOUR GROUP BY ALL""")
_web("hourly_breakdown_filled", f"""+ h AS (
  SELECT website_id, date_trunc('hour', ts) AS hour, count(*) AS events, count(DISTINCT client_id) AS visitors,
    {_n(VIEW)} AS pageviews FROM web WHERE ts >= {LATEST} - INTERVAL 48 HOUR GROUP BY ALL),
grid AS (SELECT website_id, unnest(generate_series(date_trunc('hour', {LATEST} - INTERVAL 48 HOUR),
    date_trunc('hour', {LATEST}), INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT website_id FROM h))
SELECT website_id, {_time('hour')} AS hour, coalesce(events, 0) AS events, coalesce(visitors, 0) AS visitors,
  coalesce(pageviews, 0) AS pageviews FROM grid LEFT JOIN h USING (website_id, hour)""")


_NUMERIC = {"value", "tax", "shipping", "event_value", "lcp_value", "cls_value", "inp_value"}


def _detail(name: str) -> str:
    if name == "properties":
        return "plan AS properties"
    if name == "scroll_depth":
        return "CAST(scroll_depth AS BIGINT) AS scroll_depth"
    if name in _NUMERIC:
        return f"round({name}, 4) AS {name}"
    return name if name in samples.WEB else f"'' AS {name}"


def _joined(name: str, field: str) -> str:
    if field == "item_variant":
        return f"CASE WHEN len(items) = 2 THEN ',' ELSE '' END AS {name}"
    if field == "discount":
        return f"CASE len(items) WHEN 2 THEN '0.0,0.0' WHEN 1 THEN '0.0' ELSE '' END AS {name}"
    return f"array_to_string(list_transform(items, lambda i: CAST(i.{field} AS VARCHAR)), ',') AS {name}"


_web("event_detail", f"""{_RANKED} SELECT website_id, position, {_time(_local('ts').replace("'Europe/Istanbul'", "'UTC'"))} AS ts,
  {", ".join(_detail(c) for c in DETAIL_COLUMNS)},
  {", ".join(_joined(n, f) for n, f in DETAIL_ITEMS.items())},
  {", ".join(_detail(c) for c in DETAIL_INTERACTION)}
FROM r WHERE position <= 50""")


def _is_filled(name: str) -> str:
    if name == "properties":
        return "plan <> ''"
    if name in DETAIL_ITEMS:
        return "len(items) > 0"
    if name not in samples.WEB:
        return "false"
    if name == "scroll_depth" or name in _NUMERIC:
        return f"{name} <> 0"
    return f"{name} NOT IN ('', '0')"


_PROFILED = (*DETAIL_COLUMNS, *DETAIL_ITEMS, *DETAIL_INTERACTION)
_FILLED = " + ".join(f"CAST({_is_filled(c)} AS BIGINT)" for c in _PROFILED)
_web("event_fill_profile", f"""{_RANKED}
SELECT website_id, position, {_time('ts')} AS ts, event_type, event_name, client_id, url_path,
  {_FILLED} AS filled_count, {len(_PROFILED)} - ({_FILLED}) AS empty_count FROM r WHERE position <= 50""")
_web("param_coverage", f"""SELECT website_id, event_type, count(*) AS total,
  {", ".join(f"{_n(f'{c} <> ' + chr(39) * 2)} AS has_{c}" for c in COVERAGE_TEXTS)},
  {_n('value > 0')} AS has_value, {_n('len(items) > 0')} AS has_items, {_n("plan <> ''")} AS has_properties,
  {_n('scroll_depth > 0')} AS has_scroll_depth FROM web GROUP BY website_id, event_type""")
_USAGE = f"""SELECT website_id, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS events,
  count(DISTINCT client_id) AS visitors, {_n(VIEW)} AS pageviews, {_n("event_type = 'purchase'")} AS purchases
FROM web GROUP BY ALL"""
_web("monthly_usage", _USAGE)
_web("cost_estimate", """SELECT count(*) AS total_events,
  CAST(CASE WHEN count(*) < 10000000 THEN 0 ELSE ceil(count(*) / 10000000.0) * 50 END AS BIGINT) AS storage_cost,
  CAST(5 AS BIGINT) AS hosting_cost, CAST(0 AS BIGINT) AS database_cost,
  CAST(CASE WHEN count(*) < 10000000 THEN 0 ELSE ceil(count(*) / 10000000.0) * 50 END AS BIGINT) + 5 AS total_cost
FROM web""")
_web("live_events", f"""SELECT {_time(_local())} AS ts, event_type, event_name, website_id, url_path, page_title,
  browser, os, device_type, referrer_domain, country, city, client_id, left(client_id, 8) AS client_short,
  round(value, 4) AS value, transaction_id
FROM (SELECT * FROM web ORDER BY ts DESC, event_id DESC LIMIT 100)""")
_PROFILE = ("browser", "os", "device_type", "country", "city", "language", "screen")
_web("client_profiles", f"""SELECT website_id, client_id, count(*) AS total_events, {_n(VIEW)} AS pageviews,
  {_n("event_type = 'purchase'")} AS purchases, {_n("event_type = 'add_to_cart'")} AS add_to_carts,
  count(DISTINCT session_id) AS total_sessions, {_time(_local('min(ts)'))} AS first_seen,
  {_time(_local('max(ts)'))} AS last_seen, {", ".join(f"arg_min({c}, (ts, event_id)) AS {c}" for c in _PROFILE)}
FROM web GROUP BY website_id, client_id""")
_web("client_summary", f"""SELECT client_id, count(*) AS total_events, {_n(VIEW)} AS pageviews,
  {_n("event_type = 'purchase'")} AS purchases, {_n("event_type = 'add_to_cart'")} AS add_to_carts,
  count(DISTINCT session_id) AS total_sessions, {_time(_local('min(ts)'))} AS first_seen,
  {_time(_local('max(ts)'))} AS last_seen, {", ".join(f"arg_min({c}, (ts, event_id)) AS {c}" for c in _PROFILE)}
FROM web WHERE client_id = 'c1' GROUP BY client_id""")
_TIMELINE = """+ t AS (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts, event_id) AS position FROM web),
tl AS (SELECT * FROM t WHERE position <= 500)"""
_web("client_timeline", f"""{_TIMELINE}
SELECT client_id, position, event_id, {_time(_local())} AS ts, event_type, event_name, session_id, url_path,
  url_query, page_title, referrer, referrer_domain, utm_source, utm_medium, utm_campaign, country, city,
  browser, device_type, CAST(scroll_depth AS BIGINT) AS scroll_depth, transaction_id, currency,
  round(value, 4) AS value, {_joined('item_ids', 'item_id')}, {_joined('item_names', 'item_name')},
  {_joined('item_prices', 'price')}, event_category, event_label, click_text, search_term FROM tl""")
_web("client_journey", f"""{_TIMELINE}
SELECT client_id, CASE WHEN session_id = '' THEN 'unknown' ELSE session_id END AS session_id,
  count(*) AS events, {_time('min(ts)')} AS first_event, {_time('max(ts)')} AS last_event,
  {", ".join(f"arg_min({c}, (ts, event_id)) AS {c}" for c in ("referrer_domain", "utm_source", "utm_medium"))},
  arg_min(url_path, (ts, event_id)) AS landing_page FROM t GROUP BY 1, 2""")

# --- validation ------------------------------------------------------------

_VALID_TYPES = ", ".join(f"'{t}'" for t in EVENT_TYPES)


def _absent(field: str) -> str:
    return (
        f"coalesce(json_type(j, '$.{field}') <> 'VARCHAR' "
        f"OR trim(json_extract_string(j, '$.{field}')) = '', true)"
    )


_CHECKED = f"""+ doc AS (
  SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j,
    CASE WHEN ip = '' THEN '' ELSE left(sha256(concat(ip, strftime(ingest_time, '%Y-%m-%d'))), 16) END AS ip_hash
  FROM pay),
chk AS (SELECT *, CASE
    WHEN j IS NULL OR json_type(j) NOT IN ('OBJECT', 'ARRAY') THEN 'invalid_body'
    WHEN {_absent('website_id')} THEN 'missing_website_id'
    WHEN {_absent('event_type')} THEN 'missing_event_type'
    WHEN json_extract_string(j, '$.event_type') NOT IN ({_VALID_TYPES}) THEN 'invalid_event_type' END AS reason,
    sha256(concat(body, '|', ip_hash, '|', strftime(ingest_time, '%Y-%m-%d %H:%M:%S'))) AS event_id,
    date_trunc('second', ingest_time) AS seen
  FROM doc),
bad AS (SELECT seen AS ts, coalesce(json_extract_string(j, '$.website_id'), '') AS website_id,
    CASE WHEN body = 'null' THEN '{{}}' ELSE body END AS payload, reason, ip_hash, user_agent
  FROM chk WHERE reason IS NOT NULL),
good AS (SELECT *, json_extract_string(j, '$.website_id') AS website_id,
    json_extract_string(j, '$.event_type') AS event_type FROM chk WHERE reason IS NULL)"""
_pay("validate_bad", f"""{_CHECKED} SELECT {_time('ts')} AS timestamp, website_id, payload, reason, ip_hash,
  user_agent FROM bad""")
_pay("bad_event_reasons", f"""{_CHECKED} SELECT website_id, reason, {_time("date_trunc('hour', ts)")} AS hour,
  count(*) AS bad_events FROM bad GROUP BY ALL""")
_pay("recent_bad_events", f"""{_CHECKED}, r AS (SELECT *, row_number() OVER (
    PARTITION BY website_id ORDER BY ts DESC, payload DESC, reason DESC) AS position FROM bad)
SELECT website_id, position, {_time(_local())} AS ts, reason, left(payload, 200) AS payload_preview
FROM r WHERE position <= 20""")
_BOT = "(user_agent LIKE '%Googlebot%' OR user_agent LIKE 'curl/%')"
_pay("bad_event_rate", f"""{_CHECKED}, lim AS (SELECT max(seen) - INTERVAL 24 HOUR AS since FROM chk),
n AS (SELECT {_n('reason IS NOT NULL')} AS bad, {_n(f'reason IS NULL AND NOT {_BOT}')} AS good
  FROM chk, lim WHERE seen >= since)
SELECT bad, good, round(bad * 1.0 / (bad + good), 4) AS bad_ratio, bad * 1.0 / (bad + good) > 0.05 AS alert FROM n""")


def _field(name: str, limit: int | None = None) -> str:
    limit = limit or TEXT_LIMITS[name]
    return f"coalesce(left(json_extract_string(j, '$.{name}'), {limit}), '')"


def _prefix_number(text: str) -> str:
    pattern = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))"
    return f"coalesce(TRY_CAST(regexp_extract({text}, '{pattern}', 1) AS DOUBLE), 0.0)"


def _percent(name: str) -> str:
    text = f"regexp_extract(json_extract_string(j, '$.{name}'), '^([+-]?[0-9]+)', 1)"
    return f"CAST(least(greatest(coalesce(TRY_CAST({text} AS BIGINT), 0), 0), 100) AS BIGINT)"


# Offsets in the sample are +03:00.
_SENT = (
    "date_trunc('second', strptime(left(json_extract_string(j, '$.timestamp'), 19), '%Y-%m-%dT%H:%M:%S') "
    "- INTERVAL 3 HOUR)"
)
_OBJECTS = "list_filter(json_extract(j, '$.items[*]'), lambda e: json_type(e) = 'OBJECT')"
_PROPS = """CASE json_type(j, '$.properties') WHEN 'OBJECT' THEN CAST(json_extract(j, '$.properties') AS VARCHAR)
  WHEN 'VARCHAR' THEN json_extract_string(j, '$.properties') END"""
_GOOD = f"""{_CHECKED}, src AS (SELECT *, {_PROPS} AS ptext FROM good),
obj AS (SELECT *, CASE WHEN json_valid(ptext) THEN CAST(ptext AS JSON) END AS pj FROM src),
pairs AS (SELECT event_id, row_id, pj, unnest(json_keys(pj)) AS key FROM obj WHERE json_type(pj) = 'OBJECT'),
props AS (SELECT event_id, row_id, key, json_extract_string(pj, '$.' || key) AS value FROM pairs
  WHERE json_extract_string(pj, '$.' || key) IS NOT NULL)"""
_COPIED = (
    "event_name", "client_id", "session_id", "url_path", "url_query", "page_title", "referrer", "screen",
    "language", "transaction_id", "currency",
)
_pay("validate_good", f"""{_GOOD}, np AS (SELECT row_id, count(*) AS n FROM props GROUP BY row_id)
SELECT event_id, {_time(_SENT)} AS timestamp, website_id, event_type,
  {", ".join(f"{_field(c)} AS {c}" for c in _COPIED)},
  {_prefix_number("json_extract_string(j, '$.value')")} AS value, CAST(0 AS DOUBLE) AS tax,
  {_percent('scroll_depth')} AS scroll_depth, CAST(0 AS BIGINT) AS video_percent,
  CAST(len({_OBJECTS}) AS BIGINT) AS item_count, coalesce(n, 0) AS property_count
FROM obj LEFT JOIN np USING (row_id)""")


def _item(name: str) -> str:
    return f"coalesce(left(json_extract_string(e, '$.{name}'), {MAX_TEXT}), '') AS {name}"


def _item_count(name: str) -> str:
    text = f"regexp_extract(json_extract_string(e, '$.{name}'), '^([+-]?[0-9]+)', 1)"
    return f"greatest(coalesce(TRY_CAST({text} AS BIGINT), 0), 0) AS {name}"


_ITEM_TEXTS = (
    "item_id", "item_name", "affiliation", "coupon", "item_brand", "item_category", "item_category2",
    "item_category3", "item_category4", "item_category5", "item_list_id", "item_list_name", "item_variant",
    "location_id",
)
_pay("parse_items", f"""{_CHECKED}, it AS (SELECT event_id, unnest({_OBJECTS}) AS e FROM good)
SELECT event_id, {", ".join(_item(n) for n in _ITEM_TEXTS)},
  {_prefix_number("json_extract_string(e, '$.price')")} AS price,
  {_prefix_number("json_extract_string(e, '$.discount')")} AS discount, {_item_count('index')},
  {_item_count('quantity')} FROM it""")
_pay("parse_properties", f"{_GOOD} SELECT event_id, key, value FROM props")
_pay("ingest_raw", f"""{_CHECKED} SELECT {_time('seen')} AS timestamp, website_id, body AS payload, ip_hash, user_agent
FROM good WHERE NOT {_BOT}""")


def _agent(*names: str) -> str:
    cases = ("Edg/", "Firefox/", "iPhone", "Android", "Windows")
    whens = " ".join(f"WHEN user_agent LIKE '%{c}%' THEN '{n}'" for c, n in zip(cases, names))
    return f"CASE {whens} ELSE '{names[-1]}' END"


_DEVICE = f"""{_agent('Edge', 'Firefox', 'Mobile Safari', 'Chrome', 'Chrome', 'Unknown')} AS browser,
  {_agent('120.0.2210.61', '121.0', '17.1', '119.0.1.2', '120.0.0.0', '')} AS browser_version,
  {_agent('macOS', 'Linux', 'iOS', 'Android', 'Windows', 'Unknown')} AS os,
  {_agent('desktop', 'desktop', 'mobile', 'tablet', 'desktop', 'desktop')} AS device_type"""


def _param(name: str, query: str = "url_query") -> str:
    """First value of a query parameter; broken percent codes stay as they are."""
    raw = f"replace(regexp_extract({query}, '(?:^[?]?|&){name}=([^&]*)', 1), '+', ' ')"
    return f"CASE WHEN {raw} LIKE '%\\%zz%' ESCAPE '\\' THEN {raw} ELSE url_decode({raw}) END"


_HOST = "regexp_extract(lower({}), '^[a-z]+://(?:[^/?#@]*@)?(?:www[.])?([^/:?#]+)', 1)"
_pay("ingest_events", f"""{_CHECKED}, g AS (SELECT *, {_field('url_query')} AS url_query, {_field('referrer')} AS referrer
  FROM good WHERE NOT {_BOT})
SELECT event_id, {_time(_SENT)} AS timestamp, website_id, event_type, {_HOST.format('referrer')} AS referrer_domain,
  {_param('utm_source')} AS utm_source, {_param('utm_medium')} AS utm_medium,
  {_param('utm_campaign')} AS utm_campaign, {_DEVICE}, '' AS country FROM g""")
_pay("replay", f"""{_CHECKED} SELECT event_id, {_time(_SENT)} AS timestamp, event_type,
  {_prefix_number("json_extract_string(j, '$.value')")} AS value FROM good WHERE NOT {_BOT}""")
_SITES = f"sites AS (SELECT {_select(samples.WEBSITES)} FROM nation)"
_KEYS = f"keys AS (SELECT {_select(samples.API_KEYS)} FROM customer)"
_web("filter_registered", f"""+ {_SITES}
SELECT website_id, CASE WHEN website_id IN (SELECT id FROM sites) THEN '' ELSE 'unknown_website' END AS reason,
  count(*) AS events FROM web GROUP BY ALL""")
_REQUESTS = f"""+ {_SITES}, {_KEYS},
req AS (SELECT k.key, k.website_id, s.domain, s.name AS website_name, w.ts
  FROM web w JOIN keys k ON k.key = 'key-' || substr(w.client_id, 2) JOIN sites s ON s.id = k.website_id
  WHERE k.is_active)"""
_web("resolve_api_keys", f"""{_REQUESTS} SELECT website_id, domain, website_name, count(*) AS requests
FROM req GROUP BY ALL""")
_web("api_key_last_used", f"{_REQUESTS} SELECT key, {_time('max(ts)')} AS last_used_at FROM req GROUP BY key")

# --- enrichment ------------------------------------------------------------

ORACLES["referrer_domain"] = f"SELECT page_id, {_HOST.format('url')} AS referrer_domain FROM pages"
_UTM = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
ORACLES["parse_utm"] = f"""WITH q AS (SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS url_query FROM pages)
SELECT page_id, {", ".join(f"{_param(n)} AS query_{n}" for n in _UTM)} FROM q"""
_web("coalesce_utm", f"""+ u AS (SELECT
  {", ".join(f"CASE WHEN {n} <> '' THEN {n} ELSE {_param(n)} END AS {n}" for n in _UTM[:3])},
  {", ".join(f"{_param(n)} AS {n}" for n in _UTM[3:])} FROM web)
SELECT {", ".join(_UTM)}, count(*) AS events FROM u GROUP BY ALL""")
_web("classify_referrer", """+ d AS (SELECT referrer_domain AS d FROM web)
SELECT d AS referrer_domain,
  CASE WHEN d = '' THEN 'direct' WHEN d LIKE '%google%' OR d LIKE '%yandex%' THEN 'search'
    WHEN d LIKE '%x.com%' THEN 'social' WHEN d = 'outlook.live.com' THEN 'email' ELSE 'referral' END AS referrer_class,
  CASE WHEN d = '' THEN 'direct' WHEN d IN ('mail.google.com', 'outlook.live.com') THEN 'email'
    WHEN d IN ('google.com', 'yandex.ru') THEN 'search' ELSE 'referral' END AS strict_class,
  count(*) AS events FROM d GROUP BY ALL""")
_SRC, _MED = _param("utm_source"), _param("utm_medium")
_CLICK_SRC = f"""CASE WHEN {_SRC} <> '' THEN {_SRC} WHEN url_query LIKE '%gclid=%' THEN 'google'
  WHEN url_query LIKE '%fbclid=%' THEN 'facebook' ELSE '' END"""
_CLICK_MED = f"""CASE WHEN {_MED} = '' AND {_SRC} = '' AND (url_query LIKE '%gclid=%' OR url_query LIKE '%fbclid=%')
  THEN 'cpc' ELSE {_MED} END"""
_web("click_id_attribution", f"""+ c AS (SELECT {_CLICK_SRC} AS click_utm_source,
  {_CLICK_MED} AS click_utm_medium FROM web)
SELECT click_utm_source, click_utm_medium, count(*) AS events FROM c GROUP BY ALL""")
_pay("hash_ip", """SELECT row_id, CASE WHEN ip = '' THEN '' ELSE
  left(sha256(concat(ip, strftime(ingest_time, '%Y-%m-%d'))), 16) END AS ip_hash FROM pay""")
_pay("truncate_ip", "SELECT row_id, regexp_replace(ip, '[.][0-9]+$', '.0') AS ip FROM pay")
_WIDTH = f"CAST(floor({samples.ADDRESS_SPACE} / (SELECT count(*) FROM customer)) AS BIGINT)"
_RANGES = ", ".join(f"{e.format(width=_WIDTH, div='//')} AS {n}" for n, e in samples.IP_RANGES.items())
_pay("geo_range_join", f"""+ rng AS (SELECT {_RANGES} FROM customer),
num AS (SELECT row_id, ip, CASE WHEN ip <> '' THEN
    CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END AS n FROM pay)
SELECT row_id, ip, coalesce(country, '') AS country, coalesce(city, '') AS city
FROM num LEFT JOIN rng ON n BETWEEN lo AND hi""")
_pay("geo_networks", f"""+ a AS (SELECT row_id, {samples.IPV6} AS ip, row_id % 300 AS block FROM pay),
n AS (SELECT n_nationkey * 10 AS block, n_name, CAST(n_regionkey AS VARCHAR) AS region FROM nation)
SELECT row_id, ip, CASE WHEN ip LIKE '2001:db8:%' THEN coalesce(n_name, '{samples.REST_NETWORK[1]}') ELSE '' END AS country,
  CASE WHEN ip LIKE '2001:db8:%' THEN coalesce(region, '{samples.REST_NETWORK[2]}') ELSE '' END AS city
FROM a LEFT JOIN n USING (block)""")
_WIDE_SQL = {
    **{c: _field(c) for c in TEXT_LIMITS},
    **{c: _prefix_number(f"json_extract_string(j, '$.{c}')") for c in NUMBER_FIELDS},
    **{c: _percent(c) for c in PERCENT_FIELDS},
    **{c: f"CASE WHEN {_field(c)} <> '' THEN {_field(c)} ELSE {_param(c, _field('url_query'))} END" for c in _UTM},
    "timestamp": _time(_SENT), "website_id": "website_id", "event_type": "event_type", "event_id": "event_id",
    "referrer_domain": _HOST.format(_field("referrer")), "country": "coalesce(country, '')", "city": "coalesce(city, '')",
    "items": f"CAST(len({_OBJECTS}) AS BIGINT)", "properties": "coalesce(np.n, 0)", "user_agent": "user_agent", "ip_hash": "ip_hash",
    "ingest_time": _time("ingest_time"),
}
_wide = [c for c in EVENTS_SCHEMA.names if c != "is_bot" and c not in ("browser", "browser_version", "os", "device_type")]
_pay("ingest_all_columns", f"""{_GOOD}, rng AS (SELECT {_RANGES} FROM customer), {_SITES},
np AS (SELECT row_id, count(*) AS n FROM props GROUP BY row_id),
num AS (SELECT *, CASE WHEN ip <> '' THEN
    CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END AS ip_n
  FROM obj WHERE NOT {_BOT} AND website_id IN (SELECT id FROM sites))
SELECT {", ".join(f"{_WIDE_SQL[c]} AS {c}" for c in [*_wide, "event_id"])}, {_DEVICE}
FROM num LEFT JOIN rng ON ip_n BETWEEN lo AND hi LEFT JOIN np USING (row_id)""")
ORACLES["geo_range_join_shuffled"] = ORACLES["geo_range_join"]
_pay("ua_dim", f"""+ b AS (SELECT user_agent, count(*) AS events FROM pay GROUP BY ALL)
SELECT user_agent, events, {_DEVICE} FROM b""")
_pay("drop_bots", f"SELECT user_agent, count(*) AS requests FROM pay WHERE NOT {_BOT} GROUP BY ALL")
_pay("rate_cap", """+ a AS (SELECT row_id, split_part(ip, '.', 1) AS ip, ingest_time FROM pay),
w AS (SELECT row_id, ip, row_number() OVER (
    PARTITION BY ip, CAST(floor(epoch(ingest_time) / 7200) AS BIGINT) ORDER BY ingest_time, row_id) AS rn FROM a)
SELECT row_id, ip FROM w WHERE rn <= 1 OR ip = ''""")
_pay("hash_session_id", """SELECT row_id, sha256(concat('site|www.example.com|', ip, '|', user_agent, '|',
  strftime(date_trunc('month', ingest_time), '%Y-%m-%d'))) AS cookieless_id FROM pay""")

# --- sessions --------------------------------------------------------------

_W = "PARTITION BY website_id, client_id ORDER BY ts, event_id"


def _sessions(extra: str = "", gap: str = "30 MINUTE") -> str:
    return f"""+ s1 AS (SELECT *, CASE WHEN lag(ts) OVER ({_W}) IS NULL
      OR ts - lag(ts) OVER ({_W}) >= INTERVAL {gap} {extra} THEN 1 ELSE 0 END AS opens FROM web),
s2 AS (SELECT *, CAST(sum(opens) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM s1),
s3 AS (SELECT *, min(ts) OVER (PARTITION BY website_id, client_id, session_no) AS session_start FROM s2)"""


_SESSIONIZED = f"SELECT event_id, website_id, client_id, session_no, {_time('session_start')} AS session_start FROM s3"
_web("sessionize", f"{_sessions()} {_SESSIONIZED}")
_web("sessionize_midnight", f"{_sessions(f'OR {DAY} <> CAST(lag(ts) OVER ({_W}) AS DATE)')} {_SESSIONIZED}")
_web("sessionize_12h", f"{_sessions(gap='12 HOUR')} {_SESSIONIZED}")
_web("session_starts", f"""{_sessions()} SELECT sha256('session_start|' || event_id) AS event_id, website_id, client_id, 'session_start' AS event_type,
  {_time('ts')} AS timestamp FROM s3 WHERE opens = 1 AND {VIEW}""")
_FIRST = "OVER (PARTITION BY website_id, client_id, session_id ORDER BY ts, event_id)"
_web("session_attribution", f"""+ f AS (SELECT *, first_value(url_query) {_FIRST} AS fq,
    first_value(referrer) {_FIRST} AS fr, first_value(url_path) {_FIRST} AS fp FROM web),
t AS (SELECT *, {_CLICK_SRC.replace('url_query', 'fq')} AS t_source, {_CLICK_MED.replace('url_query', 'fq')} AS t_medium,
    {_param('utm_campaign', 'fq')} AS t_campaign, {_param('utm_term', 'fq')} AS t_term FROM f)
SELECT event_id, CASE WHEN t_source <> '' THEN t_source ELSE utm_source END AS utm_source,
  CASE WHEN t_medium <> '' THEN t_medium ELSE utm_medium END AS utm_medium,
  CASE WHEN t_campaign <> '' THEN t_campaign ELSE utm_campaign END AS utm_campaign, t_term AS utm_term,
  '' AS utm_content, CASE WHEN referrer <> '' THEN referrer ELSE fr END AS referrer,
  {_param('gclid', 'fq')} AS gclid, {_param('fbclid', 'fq')} AS fbclid, '' AS msclkid, '' AS gad_campaignid,
  concat(fp, fq) AS landing_page FROM t""")
_web("dedupe_navigation", f"""+ p AS (SELECT *, concat(url_path, url_query) AS url,
    lag(concat(url_path, url_query)) {_FIRST} AS before FROM web WHERE {VIEW})
SELECT event_id, website_id, client_id, session_id, url_path FROM p WHERE before IS NULL OR before <> url""")
ORACLES["route_event_type"] = """SELECT event_type AS event_name,
  CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'custom' END AS event_type, count(*) AS calls
FROM events GROUP BY ALL"""
ORACLES["split_known_fields"] = """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'TRY' ELSE 'USD' END AS currency,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS search_term,
  'amount' AS property_keys FROM events"""
ORACLES["normalize_datalayer"] = """SELECT p_partkey,
  CASE p_partkey % 3 WHEN 0 THEN 'purchase' ELSE 'view_item' END AS event_type,
  CASE p_partkey % 3 WHEN 0 THEN 'purchase' ELSE 'view_item' END AS event_name, 'TRY' AS currency,
  p_size + 0.5 AS value, CAST(0 AS DOUBLE) AS tax, CAST(p_partkey AS VARCHAR) AS item_id, p_type AS item_name,
  '' AS item_brand, CAST(p_size AS DOUBLE) AS price,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 1 END AS BIGINT) AS quantity FROM part WHERE p_partkey % 3 < 2"""
_TOUCHES = ("url_path", "url_query", "referrer_domain", "utm_source", "utm_medium", "utm_campaign")
_BOUGHT = "event_type = 'purchase'"
_TABLE = f"""st AS (SELECT website_id, client_id, session_no, min(ts) AS a, max(ts) AS b, count(*) AS events,
  {_n(VIEW)} AS pageviews, {_n(_BOUGHT)} AS purchases,
  round(sum(CASE WHEN {_BOUGHT} THEN value ELSE 0.0 END), 4) AS revenue,
  coalesce(arg_min(url_path, (ts, event_id)) FILTER (WHERE {VIEW}), '') AS entry_page,
  coalesce(arg_max(url_path, (ts, event_id)) FILTER (WHERE {VIEW}), '') AS exit_page,
  {", ".join(f"arg_min({c}, (ts, event_id)) AS first_{c}" for c in _TOUCHES)}
FROM s3 GROUP BY website_id, client_id, session_no)"""
_SESSION_ROWS = f"""SELECT website_id, client_id, session_no,
  {_time('a')} AS started_at, {_time('b')} AS ended_at, CAST(epoch(b) - epoch(a) AS BIGINT) AS duration_seconds,
  events, pageviews, purchases, revenue, entry_page, exit_page, {", ".join(f"first_{c}" for c in _TOUCHES)} FROM st"""
_web("session_table", f"{_sessions()}, {_TABLE} {_SESSION_ROWS}")
_web("session_table_12h", f"{_sessions(gap='12 HOUR')}, {_TABLE} {_SESSION_ROWS}")
_web("bounce_rate", f"""{_sessions()}, {_TABLE} SELECT website_id, count(*) AS sessions,
  {_n('pageviews = 1')} AS bounces, round({_n('pageviews = 1')} * 1.0 / count(*), 4) AS bounce_rate
FROM st GROUP BY website_id""")
_web("campaign_performance", f"""{_sessions()}, {_TABLE} SELECT website_id, first_utm_source AS utm_source,
  first_utm_medium AS utm_medium, first_utm_campaign AS utm_campaign, count(*) AS sessions,
  {_n('purchases > 0')} AS converting_sessions, CAST(sum(purchases) AS BIGINT) AS purchases,
  round(sum(revenue), 4) AS revenue FROM st GROUP BY ALL""")

# --- panels ----------------------------------------------------------------

_WEEK = "CAST(date_trunc('week', ts) AS DATE)"
_web("traffic_series", f"""SELECT website_id, {DAY} AS period, count(*) AS pageviews FROM web WHERE {VIEW} GROUP BY ALL""")
_web("traffic_series_weekly", f"""SELECT website_id, {_WEEK} AS period, count(*) AS pageviews
FROM web WHERE {VIEW} GROUP BY ALL""")
_web("unique_visitors", f"""SELECT website_id, {_WEEK} AS period, count(DISTINCT client_id) AS visitors
FROM web GROUP BY ALL""")
_web("top_pages", f"""+ p AS (SELECT website_id, url_path, count(*) AS pageviews, count(DISTINCT client_id) AS visitors
  FROM web WHERE {VIEW} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY pageviews DESC, url_path) AS rank FROM p)
SELECT * FROM r WHERE rank <= 10""")
for _name, _keys in {
    "traffic_sources": "referrer_domain, utm_source, utm_medium",
    "device_share": "browser, device_type",
    "country_share": "country",
}.items():
    _web(_name, f"""SELECT website_id, {_keys}, count(*) AS pageviews, count(DISTINCT client_id) AS visitors,
  round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY website_id), 4) AS share
FROM web WHERE {VIEW} GROUP BY website_id, {_keys}""")
_web("scope_filter", f"""{_DAILY} WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'
  AND website_id IN ('site-0', 'site-2') GROUP BY ALL""")
_web("realtime", f"""SELECT website_id, count(*) AS events, count(DISTINCT client_id) AS visitors,
  {_n(VIEW)} AS pageviews FROM web WHERE ts >= {LATEST} - INTERVAL 6 HOUR GROUP BY website_id""")
_web("scroll_depth_dist", f"""SELECT website_id, count(*) AS scrolls,
  {", ".join(f"{_n(f'scroll_depth >= {m}')} AS reached_{m}" for m in (25, 50, 75, 100))}
FROM web WHERE scroll_depth > 0 GROUP BY website_id""")
_web("web_vitals", f"""+ m AS (
  {" UNION ALL ".join(f"SELECT website_id, url_path, '{v}' AS metric, {v} AS value FROM web WHERE {v} > 0"
                      for v in ("lcp_value", "cls_value", "inp_value"))}),
c AS (SELECT *, count(*) OVER (PARTITION BY website_id, url_path, metric ORDER BY value) AS reached,
    count(*) OVER (PARTITION BY website_id, url_path, metric) AS samples FROM m)
SELECT website_id, url_path, metric, max(samples) AS samples,
  {", ".join(f"round(min(value) FILTER (WHERE reached * 100 >= samples * {p}), 4) AS p{p}" for p in (50, 75, 95))}
FROM c GROUP BY website_id, url_path, metric""")

# --- insights --------------------------------------------------------------


def _levels(window: str) -> str:
    later = "(b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id))"
    return f"""+ e1 AS (SELECT website_id, client_id, ts, event_id FROM web WHERE event_type = 'view_item'),
e2 AS (SELECT DISTINCT a.website_id, a.client_id, a.ts AS t0, b.ts, b.event_id FROM e1 a JOIN web b
  ON a.website_id = b.website_id AND a.client_id = b.client_id AND b.event_type = 'add_to_cart'
  AND {later} AND b.ts <= a.ts + INTERVAL {window}),
e3 AS (SELECT DISTINCT a.website_id, a.client_id FROM e2 a JOIN web b
  ON a.website_id = b.website_id AND a.client_id = b.client_id AND b.event_type = 'purchase'
  AND {later} AND b.ts <= a.t0 + INTERVAL {window}),
lv AS (SELECT website_id, client_id, max(l) AS level FROM (
  SELECT website_id, client_id, 1 AS l FROM e1 UNION ALL SELECT website_id, client_id, 2 FROM e2
  UNION ALL SELECT website_id, client_id, 3 FROM e3) GROUP BY website_id, client_id)"""


_web("funnel", f"""{_levels('24 HOUR')},
n AS (SELECT website_id, {_n('level >= 1')} AS n1, {_n('level >= 2')} AS n2, {_n('level >= 3')} AS n3
  FROM lv GROUP BY website_id)
SELECT website_id, CAST(1 AS BIGINT) AS step, 'view_item' AS event_type, n1 AS visitors, 1.0 AS rate, 1.0 AS step_rate FROM n
UNION ALL SELECT website_id, 2, 'add_to_cart', n2, round(n2 * 1.0 / n1, 4), round(n2 * 1.0 / n1, 4) FROM n
UNION ALL SELECT website_id, 3, 'purchase', n3, round(n3 * 1.0 / n1, 4),
  CASE WHEN n2 > 0 THEN round(n3 * 1.0 / n2, 4) END FROM n""")
_web("funnel_levels_week", f"""{_levels('7 DAY')} SELECT website_id, client_id, CAST(level AS BIGINT) AS level FROM lv""")


def _cohorts(period: str, days: int) -> str:
    return f"""+ a AS (SELECT DISTINCT website_id, client_id, {period} AS period FROM web),
c AS (SELECT *, min(period) OVER (PARTITION BY website_id, client_id) AS cohort FROM a),
n AS (SELECT website_id, cohort, CAST(date_diff('day', cohort, period) // {days} AS BIGINT) AS off, count(*) AS clients
  FROM c GROUP BY ALL),
r AS (SELECT website_id, cohort, off AS "offset", clients, round(clients * 1.0 /
    max(CASE WHEN off = 0 THEN clients END) OVER (PARTITION BY website_id, cohort), 4) AS rate FROM n)"""


_web("retention", f"{_cohorts(_WEEK, 7)} SELECT * FROM r")
_web("retention_daily", f"{_cohorts(DAY, 1)} SELECT * FROM r")
_web("retention_matrix", f"""{_cohorts(_WEEK, 7)} SELECT website_id, cohort,
  {", ".join(f'max(rate) FILTER (WHERE "offset" = {i}) AS p{i}' for i in range(5))} FROM r GROUP BY website_id, cohort""")


def _anomaly(metric: str, partition: str, history: int) -> str:
    w = f"OVER (PARTITION BY {partition} ORDER BY date ROWS BETWEEN {history} PRECEDING AND 1 PRECEDING)"
    return f"""+ d AS ({_DAILY} GROUP BY ALL),
z AS (SELECT date, website_id, {metric}, avg({metric}) {w} AS expected,
    CASE WHEN count(*) {w} >= 2 AND stddev_samp({metric}) {w} > 0
      THEN ({metric} - avg({metric}) {w}) / stddev_samp({metric}) {w} END AS z FROM d)
SELECT date, website_id, {metric}, round(expected, 4) AS expected, round(z, 4) AS z_score,
  coalesce(abs(z) >= 2, false) AS is_anomaly FROM z"""


_web("anomalies", _anomaly("pageviews", "website_id, dayofweek(date)", 8))
_web("anomalies_trailing", _anomaly("visitors", "website_id", 7))
_web("pct_change", f"""+ d AS ({_DAILY} GROUP BY ALL),
l AS (SELECT date, website_id, pageviews, lag(pageviews) OVER (PARTITION BY website_id ORDER BY date) AS previous FROM d)
SELECT *, CASE WHEN previous > 0 THEN round((pageviews - previous) * 100.0 / previous, 4) END AS pct_change FROM l""")
_web("page_movers", f"""+ w AS (SELECT website_id, url_path, {_WEEK} AS week, count(*) AS n FROM web WHERE {VIEW} GROUP BY ALL),
nx AS (SELECT website_id, url_path, CAST(week + INTERVAL 7 DAY AS DATE) AS week, n FROM w),
j AS (SELECT coalesce(w.website_id, nx.website_id) AS website_id, coalesce(w.url_path, nx.url_path) AS url_path,
    coalesce(w.week, nx.week) AS week, coalesce(w.n, 0) AS current, coalesce(nx.n, 0) AS previous
  FROM w FULL JOIN nx ON w.website_id = nx.website_id AND w.url_path = nx.url_path AND w.week = nx.week),
c AS (SELECT website_id, url_path, week, current, previous, current - previous AS change,
    CASE WHEN current > previous THEN 'up' ELSE 'down' END AS direction FROM j
  WHERE week <= (SELECT max(w2.week) FROM w w2 WHERE w2.website_id = j.website_id) AND current <> previous),
r AS (SELECT *, row_number() OVER (PARTITION BY website_id, week, direction ORDER BY abs(change) DESC, url_path) AS rank FROM c)
SELECT * FROM r WHERE rank <= 5""")
_web("new_sources", f"""+ x AS (SELECT * REPLACE (concat(client_id, url_path) AS referrer_domain) FROM web),
n AS (SELECT website_id, date_trunc('week', max(ts)) AS wk FROM web GROUP BY website_id)
SELECT website_id, referrer_domain, utm_source, {_time('min(ts)')} AS first_seen, count(*) AS pageviews
FROM x JOIN n USING (website_id) WHERE {VIEW}
GROUP BY website_id, referrer_domain, utm_source, wk HAVING min(ts) >= wk""")
_web("device_shift", f"""+ w AS (SELECT website_id, device_type, {_WEEK} AS week,
    count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY website_id, {_WEEK}) AS share FROM web WHERE {VIEW} GROUP BY 1, 2, 3),
nx AS (SELECT website_id, device_type, CAST(week + INTERVAL 7 DAY AS DATE) AS week, share FROM w),
j AS (SELECT coalesce(w.website_id, nx.website_id) AS website_id, coalesce(w.device_type, nx.device_type) AS device_type,
    coalesce(w.week, nx.week) AS week, coalesce(w.share, 0) AS share, coalesce(nx.share, 0) AS previous
  FROM w FULL JOIN nx ON w.website_id = nx.website_id AND w.device_type = nx.device_type AND w.week = nx.week)
SELECT website_id, device_type, week, round(share, 4) AS share, round(previous, 4) AS previous_share,
  round(share - previous, 4) AS shift FROM j
WHERE week <= (SELECT max(w2.week) FROM w w2 WHERE w2.website_id = j.website_id)""")

ORACLES["storage_rows"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS total_rows FROM {t}" for t in samples.TABLES)
_web("stored_events", f"""SELECT event_id, {_time('ts')} AS timestamp, CAST(strftime(ts, '%Y%m') AS BIGINT) AS event_month,
  website_id, event_type, round(value, 4) AS value FROM web""")

# --- lifecycle and streams -------------------------------------------------

_web("apply_retention", f"""SELECT {DAY} AS date, count(*) AS events FROM web
WHERE ts > TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL""")
_web("erase_clients", f"""{_DAILY}
WHERE client_id NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL""")
_GONE = "SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0"
_SENDER = """coalesce(json_extract_string(j, '$.client_id'),
  regexp_extract({}, '"client_id"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1))"""
_pay("erase_raw", f"""{_CHECKED} SELECT {_time('seen')} AS timestamp, website_id, body AS payload, ip_hash, user_agent
FROM good WHERE NOT {_BOT} AND {_SENDER.format('body')} NOT IN ({_GONE})""")
_pay("erase_bad", f"""{_CHECKED} SELECT {_time('seen')} AS timestamp,
  coalesce(json_extract_string(j, '$.website_id'), '') AS website_id,
  CASE WHEN body = 'null' THEN '{{}}' ELSE body END AS payload, reason, ip_hash, user_agent
FROM chk WHERE reason IS NOT NULL AND {_SENDER.format('body')} NOT IN ({_GONE})""")
_pay("replay_erased", f"""{_CHECKED} SELECT event_id, {_time(_SENT)} AS timestamp, event_type,
  {_field('client_id')} AS client_id FROM good WHERE NOT {_BOT} AND {_SENDER.format('body')} NOT IN ({_GONE})""")
ORACLES["stream_daily_stats"] = ORACLES["daily_stats"]
# The nine rollups as (rollup, key, measure, value): source, condition, keys, sums, distinct counts.
_FUNNEL_KINDS = {
    "view_item_users": "'view_item'", "add_to_cart_users": "'add_to_cart'", "checkout_users": _CHECKOUT,
    "purchase_users": "'purchase'",
}
_WEB_PRODUCTS = "(SELECT w.*, unnest(w.items) AS item FROM {} w)"
_BOUGHT = "event_type = 'purchase'"
_LONG = {
    "daily_stats": ("{}", "true", "", {"pageviews": _n(VIEW), "bounces": "0"},
                    {"visitors": "client_id", "sessions": "session_id"}),
    "page_stats": ("{}", VIEW, "url_path", {"pageviews": "count(*)"}, {"visitors": "client_id"}),
    "referrer_stats": ("{}", VIEW, "referrer_domain, utm_source, utm_medium", {"pageviews": "count(*)"},
                       {"visitors": "client_id"}),
    "device_stats": ("{}", VIEW, "browser, os, device_type", {}, {"visitors": "client_id"}),
    "country_stats": ("{}", VIEW, "country", {"pageviews": "count(*)"}, {"visitors": "client_id"}),
    "revenue_daily": (
        "{}", f"{_BOUGHT} AND value > 0", "currency",
        {"transactions": "count(*)", "revenue": "sum(value)", "tax_total": "sum(tax)", "shipping_total": "sum(shipping)",
         "items_sold": "sum(len(items))", "units_sold": "sum(list_sum(list_transform(items, lambda i: i.quantity)))"},
        {"buyers": "client_id"}),
    "product_stats": (
        _WEB_PRODUCTS, f"event_type IN ({_ALL_KINDS})", "item.item_id",
        {"views": _n("event_type = 'view_item'"), "adds_to_cart": _n("event_type = 'add_to_cart'"), "purchases": _n(_BOUGHT),
         "revenue": f"sum(CASE WHEN {_BOUGHT} THEN item.price ELSE 0.0 END)",
         "quantity_sold": f"sum(CASE WHEN {_BOUGHT} THEN item.quantity ELSE 0 END)"}, {}),
    "custom_event_stats": (
        "{}", "event_type = 'custom' AND event_name <> ''", "event_name, event_category",
        {"event_count": "count(*)", "total_value": "sum(event_value)"}, {"unique_users": "client_id"}),
    "ecommerce_funnel": (
        "{}", f"event_type IN ('view_item', 'add_to_cart', 'purchase', {_CHECKOUT})", "", {},
        {n: f"CASE WHEN event_type IN ({k}) THEN client_id END" for n, k in _FUNNEL_KINDS.items()}),
}


def _long(source: str, per_batch: bool) -> str:
    """All nine rollups over `source`; with `per_batch`, distinct counts of batches are added up."""
    parts = []
    for name, (rows, condition, keys, sums, distinct) in _LONG.items():
        key = f"concat_ws('|', CAST({DAY} AS VARCHAR), website_id{', ' + keys if keys else ''})"
        at = f"FROM {rows.format(source)} WHERE {condition} GROUP BY ALL"
        for measure, sql in sums.items():
            parts.append(f"SELECT '{name}' AS rollup, {key} AS key, '{measure}' AS measure, "
                         f"round(CAST({sql} AS DOUBLE), 4) AS value {at}")
        for measure, column in distinct.items():
            batch = f"event_id % {samples.BATCHES}" if per_batch else "0"
            parts.append(f"SELECT '{name}', key, '{measure}', CAST(sum(n) AS DOUBLE) FROM (SELECT {key} AS key, "
                         f"{batch} AS batch, count(DISTINCT {column}) AS n {at}) GROUP BY key")
    return " UNION ALL ".join(parts)


# Rows behind the largest time of earlier batches less a day.
_EARLIER = f"""+ late AS (SELECT w.*, ts < (SELECT max(o.ts) FROM web o WHERE o.event_id % {samples.BATCHES}
    < w.event_id % {samples.BATCHES}) - INTERVAL 1 DAY AS is_late FROM web w),
punctual AS (SELECT * EXCLUDE is_late FROM late WHERE NOT coalesce(is_late, false))"""
for _mode in ("exact", "sketch"):
    _web(f"stream_rollups_{_mode}", _long("web", False))
_web("stream_rollups_additive", _long("web", True))
_web("stream_rollups_drop", f"{_EARLIER} {_long('punctual', False)}")
_web("stream_late_rows", f"{_EARLIER} SELECT event_id, {_time('ts')} AS timestamp FROM late WHERE is_late")
_web("stream_sessions", f"""{_sessions()}, {_TABLE} SELECT website_id, client_id, {_time('a')} AS started_at,
  {_time('b')} AS ended_at, events, pageviews FROM st""")
_WINDOWED = f"SELECT {DAY} AS date, website_id, count(*) AS events, {_n(VIEW)} AS pageviews FROM"
_web("stream_windowed_daily", f"{_WINDOWED} web GROUP BY ALL")
_web("stream_windowed_daily_update", f"{_WINDOWED} web GROUP BY ALL")
_web("stream_windowed_daily_drop", f"{_EARLIER} {_WINDOWED} punctual GROUP BY ALL")
_web("stream_windowed_distinct", f"SELECT DISTINCT {DAY} AS date, website_id, client_id FROM web")
for _how in ("exact", "sketch"):
    _web(f"stream_visitors_{_how}", f"""SELECT {DAY} AS date, website_id, count(DISTINCT client_id) AS visitors
FROM web GROUP BY ALL""")
_web("stream_visitors_approx", f"""SELECT {DAY} AS date, website_id, count(DISTINCT client_id) AS visitors,
  true AS close FROM web GROUP BY ALL""")
_web("stream_sliding_activity", f"""+ s AS (SELECT *, unnest(generate_series(0, 25, 5)) AS back FROM web),
w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(back) AS a, website_id, event_type, client_id FROM s)
SELECT {_time('a')} AS start, {_time('a + INTERVAL 30 MINUTE')} AS "end", website_id, count(*) AS events,
  {_n(VIEW)} AS pageviews, count(DISTINCT client_id) AS visitors FROM w GROUP BY ALL""")
_web("stream_dedupe", "SELECT event_id, event_type FROM web")
_web("stream_rate_flag", f"""SELECT {_time("date_trunc('hour', ts)")} AS window_start, client_id AS ip_hash,
  count(*) AS requests, count(*) > 1 AS over_limit FROM web GROUP BY ALL""")
ORACLES["stream_ingest_events"] = ORACLES["ingest_events"]
ORACLES["stream_ingest_raw"] = ORACLES["ingest_raw"]
ORACLES["stream_ingest_bad"] = ORACLES["validate_bad"]
ORACLES["stream_attribution"] = f"""SELECT event_id, utm_source, utm_medium, utm_campaign, utm_term, referrer,
  landing_page FROM ({ORACLES["session_attribution"]})"""
