"""Event and payload data derived from the benchmark tables.

The expressions below are plain SQL that other engines read the same way, so results can
be checked against them. Three views of the data:

- `web_events`: the `events` table as site traffic with all event columns,
- `shop_events`: `orders` with their line items as shop events,
- `payloads`: the `events` table as posted JSON texts, good and broken ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.schema import ITEM_TYPES
from trailmark.session import configure
from trailmark.sources.tables import conform

# Columns of `web_events` over (event_id, ts, user_id, src_type, amount, k), where k is
# the 0..99 number in the properties of a row.
WEB = {
    "event_id": "event_id",
    "timestamp": "date_trunc('second', ts)",
    "event_type": (
        "CASE src_type "
        "WHEN 'view' THEN CASE WHEN k < 50 THEN 'page_view' ELSE 'view_item' END "
        "WHEN 'click' THEN CASE WHEN k < 40 THEN 'add_to_cart' WHEN k < 70 THEN 'begin_checkout' "
        "ELSE 'scroll' END "
        "WHEN 'signup' THEN CASE WHEN k < 50 THEN 'sign_up' ELSE 'custom' END "
        "ELSE src_type END"
    ),
    "event_name": (
        "CASE WHEN src_type = 'signup' AND k >= 50 "
        "THEN concat('evt_', CAST(k % 5 AS VARCHAR(9))) ELSE '' END"
    ),
    "website_id": "concat('site-', CAST(user_id % 4 AS VARCHAR(19)))",
    "client_id": "concat('c', CAST(user_id AS VARCHAR(19)))",
    "session_id": (
        "CASE WHEN k % 25 = 7 THEN '' ELSE concat('s', CAST(user_id AS VARCHAR(19)), '-', "
        "CAST(extract(DAY FROM ts) AS VARCHAR(9))) END"
    ),
    "url_path": "concat('/p/', CAST(k % 10 AS VARCHAR(9)))",
    "url_query": (
        "CASE k % 7 "
        "WHEN 0 THEN concat('?utm_source=news&utm_medium=email&utm_campaign=c', CAST(k % 3 AS VARCHAR(9))) "
        "WHEN 1 THEN '?gclid=g1' "
        "WHEN 2 THEN '?utm_source=a%20b&utm_source=c' "
        "WHEN 3 THEN '?fbclid=f1&utm_medium=paid+social' "
        "WHEN 4 THEN '?q=1&utm_term=%zz' "
        "ELSE '' END"
    ),
    "page_title": "CASE WHEN k % 4 = 0 THEN '' ELSE concat('Page ', CAST(k % 10 AS VARCHAR(9))) END",
    "referrer": (
        "CASE k % 9 WHEN 0 THEN 'https://www.Google.com/search?q=x' WHEN 1 THEN 'https://mail.google.com/' "
        "WHEN 2 THEN 'https://www.netflix.com' WHEN 3 THEN 'not a url' "
        "WHEN 4 THEN 'http://user@shop.example.org:8080/a' WHEN 5 THEN 'https://yandex.ru#top' "
        "WHEN 6 THEN 'https://outlook.live.com/mail' ELSE '' END"
    ),
    "referrer_domain": (
        "CASE k % 9 WHEN 0 THEN 'google.com' WHEN 1 THEN 'mail.google.com' WHEN 2 THEN 'netflix.com' "
        "WHEN 4 THEN 'shop.example.org' WHEN 5 THEN 'yandex.ru' WHEN 6 THEN 'outlook.live.com' ELSE '' END"
    ),
    "utm_source": "CASE k % 7 WHEN 0 THEN 'news' WHEN 2 THEN 'a b' ELSE '' END",
    "utm_medium": "CASE k % 7 WHEN 0 THEN 'email' WHEN 3 THEN 'paid social' ELSE '' END",
    "utm_campaign": "CASE k % 7 WHEN 0 THEN concat('c', CAST(k % 3 AS VARCHAR(9))) ELSE '' END",
    "country": "CASE user_id % 5 WHEN 0 THEN 'TR' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE '' END",
    "city": "CASE user_id % 5 WHEN 0 THEN 'Izmir' WHEN 1 THEN 'Boston' ELSE '' END",
    "browser": "CASE user_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE 'Firefox' END",
    "os": "CASE user_id % 3 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' ELSE 'Linux' END",
    "device_type": "CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END",
    "screen": "CASE WHEN k % 2 = 0 THEN '1920x1080' ELSE '390x844' END",
    "language": "CASE user_id % 5 WHEN 0 THEN 'tr' ELSE 'en' END",
    "transaction_id": "CASE WHEN src_type = 'purchase' THEN concat('t', CAST(event_id AS VARCHAR(19))) ELSE '' END",
    "currency": "CASE WHEN src_type <> 'purchase' THEN '' WHEN user_id % 2 = 0 THEN 'TRY' ELSE 'USD' END",
    "value": "CASE WHEN src_type = 'purchase' AND k >= 5 THEN amount ELSE CAST(0 AS DOUBLE) END",
    "tax": "CASE WHEN src_type = 'purchase' THEN CAST(k AS DOUBLE) / 4 ELSE CAST(0 AS DOUBLE) END",
    "shipping": "CASE WHEN src_type = 'purchase' THEN CAST(k % 3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "event_category": "CASE WHEN src_type = 'signup' AND k >= 50 THEN CASE WHEN k < 75 THEN 'menu' ELSE 'form' END ELSE '' END",
    "event_label": "CASE WHEN src_type = 'signup' AND k >= 90 THEN 'top' ELSE '' END",
    "event_value": "CASE WHEN src_type = 'signup' AND k >= 50 THEN amount ELSE CAST(0 AS DOUBLE) END",
    "click_text": "CASE WHEN src_type = 'click' THEN 'Buy' ELSE '' END",
    "search_term": "CASE WHEN src_type = 'view' AND k % 20 = 3 THEN 'lamp' ELSE '' END",
    "scroll_depth": "CASE WHEN src_type = 'click' AND k >= 70 THEN (k - 69) * 3 ELSE 0 END",
    "lcp_value": "CASE WHEN src_type = 'view' THEN amount * 8 ELSE CAST(0 AS DOUBLE) END",
    "cls_value": "CASE WHEN src_type = 'view' THEN CAST(k AS DOUBLE) / 128 ELSE CAST(0 AS DOUBLE) END",
    "inp_value": "CASE WHEN src_type = 'click' THEN amount ELSE CAST(0 AS DOUBLE) END",
}

# Shop events with an item list, and rows with custom properties.
HAS_ITEMS = "src_type = 'purchase' OR (src_type = 'view' AND k >= 50)"
HAS_PROPERTIES = "src_type = 'signup' AND k >= 50"

# The item fields of one line; a row holds k % 2 + 1 lines, `n` is 1 or 2.
WEB_ITEM = {
    "item_id": "concat('sku-', CAST((k + {n}) % 20 AS VARCHAR(9)))",
    "item_name": "concat('Item ', CAST((k + {n}) % 20 AS VARCHAR(9)))",
    "item_brand": "CASE WHEN k % 3 = 0 THEN 'Acme' ELSE '' END",
    "item_category": "'lamps'",
    "price": "CAST(k AS DOUBLE) / 4 + 1",
    "quantity": "CAST(k % 3 + 1 AS BIGINT)",
}


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _base(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.col("event_type").alias("src_type"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Stored rows over all cores, before anything is made of them.

    A sample is one file and so one task, in which building and parsing wide rows is the
    costly part. There are never fewer files than cores in a stored table.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `events` as a site event with the full event schema."""
    return as_web_events(load(spark, sf_dir, "events"))


def stream_web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`web_events` as a stream of the table's files."""
    layout = load(spark, sf_dir, "events").schema
    files = spark.readStream.schema(layout).option("pathGlobFilter", "events.parquet")
    return as_web_events(files.parquet(sf_dir))


BATCHES = 3


def stream_web_batches(spark: SparkSession, sf_dir: str, folder: str) -> Iterator[DataFrame]:
    """`web_events` in BATCHES micro-batches, dealt by event id: most of the later ones are late.

    Each turn adds the files of one batch to `folder` and gives the stream of that folder. Run it
    to its end from one checkpoint: what is new is one micro-batch, of as many files as there are.
    """
    source = load(spark, sf_dir, "events")
    layout, rows = source.schema, _spread(source)
    for k in range(BATCHES):
        rows.where(F.pmod(F.col("event_id"), F.lit(BATCHES)) == k).write.mode("append").parquet(folder)
        yield as_web_events(spark.readStream.schema(layout).parquet(folder))


def as_web_events(source: DataFrame) -> DataFrame:
    """Rows of the `events` layout, batch or stream, as site events."""

    def line(n: int) -> str:
        fields = []
        for name, kind in ITEM_TYPES.items():
            blank = "''" if kind.typeName() == "string" else "0"
            value = WEB_ITEM[name].format(n=n) if name in WEB_ITEM else blank
            fields.append(f"'{name}', CAST({value} AS {kind.simpleString()})")
        return f"named_struct({', '.join(fields)})"

    one, two = f"array({line(1)})", f"array({line(1)}, {line(2)})"
    items = f"CASE WHEN {HAS_ITEMS} THEN CASE WHEN k % 2 = 0 THEN {one} ELSE {two} END ELSE array() END"
    properties = (
        f"CASE WHEN {HAS_PROPERTIES} THEN map('plan', CAST(k AS STRING)) "
        "ELSE CAST(map() AS MAP<STRING, STRING>) END"
    )
    columns = [f"{expr} AS {name}" for name, expr in WEB.items()]
    events = _base(source).selectExpr(*columns, f"{items} AS items", f"{properties} AS properties")
    return conform(events)


# `shop_events` over `orders`; items come from `lineitem` joined with `part`.
SHOP = {
    "event_id": "o_orderkey",
    "timestamp": "o_orderdate",
    "event_type": "CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'view_item' ELSE 'add_to_cart' END",
    "website_id": "concat('site-', left(o_orderpriority, 1))",
    "client_id": "concat('c', CAST(o_custkey AS VARCHAR(19)))",
    "value": "CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END",
    "tax": "CAST(0 AS DOUBLE)",
    "shipping": "CAST(0 AS DOUBLE)",
    "currency": "'USD'",
}


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shop events with their line items.

    An order has few lines, so collecting them per order key stays small.
    """
    orders = load(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    item = F.struct(
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("item_brand"),
        F.col("p_type").alias("item_category"),
        F.col("p_retailprice").alias("price"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )
    per_order = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(F.collect_list(item).alias("items"))
    )
    joined = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.selectExpr(
        *[f"{expr} AS {name}" for name, expr in SHOP.items()], "coalesce(items, array()) AS items"
    )


def _json_field(name: str, value: str) -> str:
    return f"'\"{name}\":\"', {value}, '\"'"


# The quote and backslash inside the JSON text of `properties`.
_ESCAPED = "chr(92), '\"'"

_TEXT_FIELDS = (
    "event_type", "event_name", "client_id", "session_id", "url_path", "url_query", "page_title",
    "referrer", "screen", "language", "transaction_id", "currency", "event_category", "event_label",
)

_GOOD_BODY = (
    "concat('{', "
    + ", ',', ".join([
        _json_field("website_id", WEB["website_id"]),
        *[_json_field(n, WEB[n]) for n in _TEXT_FIELDS],
        _json_field("timestamp", "concat(CAST(CAST(ts AS DATE) AS VARCHAR(10)), 'T10:00:00.999+03:00')"),
        "'\"value\":', CASE WHEN k % 3 = 0 THEN concat('\"', CAST(k AS VARCHAR(9)), '.5x\"') "
        "WHEN k % 3 = 1 THEN CAST(k AS VARCHAR(9)) ELSE 'null' END",
        "'\"scroll_depth\":', CASE k % 4 WHEN 0 THEN '-1' WHEN 1 THEN '\"55%\"' WHEN 2 THEN '101' "
        "ELSE CAST(k AS VARCHAR(9)) END",
        "'\"items\":', CASE k % 5 WHEN 0 THEN '[null,\"s\",{\"item_id\":5,\"price\":\"1.5\",\"quantity\":-2}]' "
        "WHEN 1 THEN '{}' WHEN 2 THEN concat('[{\"item_id\":\"a\",\"price\":', CAST(k AS VARCHAR(9)), "
        "',\"quantity\":\"3\"},{\"item_name\":\"b\"}]') ELSE '[]' END",
        "'\"properties\":', CASE k % 4 WHEN 0 THEN '[1]' "
        "WHEN 1 THEN concat('{\"plan\":\"p', CAST(k AS VARCHAR(9)), '\",\"none\":null}') "
        f"WHEN 2 THEN concat('\"{{', {_ESCAPED}, 'k', {_ESCAPED}, ':', CAST(k AS VARCHAR(9)), '}}\"') "
        "ELSE '\"{bad\"' END",
    ])
    + ", '}')"
)

# Payload rows over the same base; some bodies are broken on purpose.
PAYLOADS = {
    "row_id": "event_id",
    "body": (
        "CASE k WHEN 0 THEN 'null' WHEN 1 THEN '\"text\"' WHEN 2 THEN '[1]' WHEN 3 THEN '{}' "
        "WHEN 4 THEN '{\"website_id\":5,\"event_type\":\"page_view\"}' "
        "WHEN 5 THEN '{\"website_id\":\"  \",\"event_type\":\"page_view\"}' "
        "WHEN 6 THEN '{\"website_id\":\"s\"}' WHEN 7 THEN '{bad' "
        "WHEN 8 THEN '{\"website_id\":\"s\",\"event_type\":\"Page_View\"}' "
        f"ELSE {_GOOD_BODY} END"
    ),
    "ip": (
        "CASE WHEN k = 50 THEN '' ELSE concat(CAST(user_id % 200 + 10 AS VARCHAR(9)), '.', "
        "CAST(k AS VARCHAR(9)), '.', CAST(user_id % 250 AS VARCHAR(9)), '.7') END"
    ),
    "user_agent": (
        "CASE user_id % 8 "
        "WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36' "
        "WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1' "
        "WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0' "
        "WHEN 3 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)' "
        "WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 14; SM-X910) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.1.2 Safari/537.36' "
        "WHEN 5 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.61' "
        "WHEN 6 THEN 'curl/8.4.0' "
        "ELSE '' END"
    ),
    "ingest_time": "ts",
}


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `events` as a posted payload; `row_id` is the source `event_id`."""
    return _base(_spread(load(spark, sf_dir, "events"))).selectExpr(
        *[f"{e} AS {n}" for n, e in PAYLOADS.items()]
    )


# Address ranges over `customer` (which must not be empty): equal slots of the address
# space from 10.0.0.0 on, three quarters of each slot assigned. `n` is the table's size.
IP_RANGES = {
    "lo": "167772160 + c_custkey * {width}",
    "hi": "167772160 + c_custkey * {width} + ({width} * 3) {div} 4",
    "country": "CAST(c_nationkey AS VARCHAR(9))",
    "city": "c_mktsegment",
}
ADDRESS_SPACE = 3_400_000_000


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer")
    width = customers.agg((F.lit(ADDRESS_SPACE) / F.count("*")).cast("long").alias("w"))
    sized = customers.withColumn("width", width.scalar())
    return sized.selectExpr(
        *[f"{e.format(width='width', div='div')} AS {n}" for n, e in IP_RANGES.items()]
    )


# IPv6 networks over `nation`, nested in one for all; and addresses for payload rows.
NETWORKS = {
    "network": "concat('2001:DB8:', CAST(n_nationkey * 10 AS VARCHAR(9)), '::/48')",
    "country": "n_name",
    "city": "CAST(n_regionkey AS VARCHAR(9))",
}
REST_NETWORK = ("2001:db8::/32", "elsewhere", "")
IPV6 = (
    "CASE WHEN row_id % 5 = 0 THEN ip WHEN row_id % 7 = 0 THEN concat('2001:db9::', CAST(row_id % 9 AS VARCHAR(9))) "
    "ELSE concat('2001:db8:', CAST(row_id % 300 AS VARCHAR(9)), '::', CAST(row_id % 9 AS VARCHAR(9)), ':1') END"
)


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "nation").selectExpr(*[f"{e} AS {n}" for n, e in NETWORKS.items()])
    return own.unionByName(spark.createDataFrame([REST_NETWORK], "network string, country string, city string"))


WEBSITES = {
    "id": "concat('site-', CAST(n_nationkey * 2 AS VARCHAR(9)))",
    "name": "n_name",
    "domain": "concat(lower(n_name), '.example.com')",
}


def websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A website register over `nation`; sites with an odd number are not in it."""
    nations = load(spark, sf_dir, "nation")
    return nations.selectExpr(*[f"{e} AS {n}" for n, e in WEBSITES.items()])


API_KEYS = {
    "key": "concat('key-', CAST(c_custkey AS VARCHAR(19)))",
    "website_id": "concat('site-', CAST(c_custkey % 4 AS VARCHAR(9)))",
    "is_active": "c_acctbal > 0",
}


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in API_KEYS.items()])
