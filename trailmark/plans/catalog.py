"""Registered queries: every operator applied to whole sample tables.

Results leave with portable types: times as text, money and ratios rounded, lists joined.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import identity, urls
from trailmark.operators import enrich, insights, lifecycle, panels, reports, rollups, sessions, validate
from trailmark.plans.ingest import ingest
from trailmark.schema import EVENTS_SCHEMA, UTM_FIELDS
from trailmark.session import work_dir
from trailmark.sources import payloads as payload_source
from trailmark.sources import samples, tables
from trailmark.streaming import ingest as stream_ingest
from trailmark.streaming import attribution, parts, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FUNNEL_STEPS = ("view_item", "add_to_cart", "purchase")
TZ = "Europe/Istanbul"


def portable(df: DataFrame) -> DataFrame:
    """Times as text, doubles rounded, integers as BIGINT."""
    out = []
    for field in df.schema.fields:
        kind, name = field.dataType.typeName(), f"`{field.name}`"
        value = {
            "timestamp": f"date_format({name}, 'yyyy-MM-dd HH:mm:ss')",
            "double": f"round({name}, 4)",
            "integer": f"CAST({name} AS BIGINT)",
            "short": f"CAST({name} AS BIGINT)",
            "array": f"array_join(CAST({name} AS ARRAY<STRING>), ',')",
        }.get(kind, name)
        out.append(f"{value} AS {name}")
    return df.selectExpr(*out)


def _add(name: str, run: Query) -> None:
    QUERIES[name] = lambda spark, sf_dir: portable(run(spark, sf_dir))


def _web(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, lambda spark, sf_dir: run(samples.web_events(spark, sf_dir)))


def _shop(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, lambda spark, sf_dir: run(samples.shop_events(spark, sf_dir)))


def _payloads(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, lambda spark, sf_dir: run(samples.payloads(spark, sf_dir)))


# --- rollups ---------------------------------------------------------------

_web("daily_stats", rollups.daily_stats)
_web("daily_stats_bounces", lambda ev: rollups.daily_stats(ev, with_bounces=True))
_web("page_stats", rollups.page_stats)
_web("referrer_stats", rollups.referrer_stats)
_web("device_stats", rollups.device_stats)
_web("country_stats", rollups.country_stats)
_shop("revenue_daily", rollups.revenue_daily)
_web("revenue_daily_web", rollups.revenue_daily)


def _totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("date", "website_id", "item_id").agg(
        F.sum("views").alias("views"),
        F.sum("adds_to_cart").alias("adds_to_cart"),
        F.sum("purchases").alias("purchases"),
        F.sum("revenue").alias("revenue"),
        F.sum("quantity_sold").alias("quantity_sold"),
    )


_shop("product_views", lambda ev: _totals(rollups.product_views(ev)))
_shop("product_carts", lambda ev: _totals(rollups.product_carts(ev)))
_shop("product_purchases", lambda ev: _totals(rollups.product_purchases(ev)))
_shop("product_stats", rollups.product_stats)
_shop("product_stats_extended", lambda ev: rollups.product_stats(ev, "extended"))
_web("custom_event_stats", rollups.custom_event_stats)
_web("ecommerce_funnel", rollups.ecommerce_funnel)


def _merged(ev: DataFrame) -> DataFrame:
    """Hourly parts of `page_stats` added up to days, as separate inserts would be."""
    parts = (
        ev.filter(F.col("event_type") == "page_view")
        .groupBy(F.date_trunc("hour", "timestamp").alias("hour"), "website_id", "url_path")
        .agg(F.count("*").alias("pageviews"), F.count_distinct("client_id").alias("visitors"))
        .withColumn("date", F.to_date("hour"))
    )
    return rollups.merge_rollups(parts, ["date", "website_id", "url_path"], ["pageviews", "visitors"])


_web("merge_rollups", _merged)
_web("distinct_sketch", lambda ev: rollups.sketch_estimate(rollups.distinct_sketch(ev)))
_web("merge_sketch", lambda ev: rollups.sketch_estimate(
    rollups.merge_sketch(rollups.distinct_sketch(ev), ["website_id"])))

# --- reports ---------------------------------------------------------------

_web("sites_overview", lambda ev: reports.sites_overview(ev, reports.latest(ev)))
_web("site_stats", lambda ev: reports.site_stats(ev, hours=48, as_of=reports.latest(ev)))
_web("recent_events", lambda ev: reports.recent_events(ev, tz=TZ))
_web("hourly_breakdown", lambda ev: reports.hourly_breakdown(ev, hours=48, tz=TZ, as_of=reports.latest(ev)))
_web("hourly_breakdown_filled", lambda ev: reports.hourly_breakdown(
    ev, hours=48, as_of=reports.latest(ev), fill=True))
_web("event_detail", lambda ev: reports.event_detail(ev).withColumn(
    "properties", F.coalesce(F.try_element_at("properties", F.lit("plan")), F.lit(""))))
_web("event_fill_profile", lambda ev: reports.event_fill_profile(reports.event_detail(ev)).drop(
    "filled_params", "empty_params"))
_web("param_coverage", reports.param_coverage)
_web("monthly_usage", reports.monthly_usage)
_web("cost_estimate", lambda ev: reports.cost_estimate(reports.monthly_usage(ev)))
_web("live_events", lambda ev: reports.live_events(ev, n=100, tz=TZ))
_web("client_profiles", lambda ev: reports.client_profiles(ev, tz=TZ))
_web("client_summary", lambda ev: reports.client_summary(ev, "c1", tz=TZ))
_web("client_timeline", lambda ev: reports.client_timeline(ev, tz=TZ).drop("properties"))
_web("client_journey", lambda ev: reports.client_journey(
    reports.client_timeline(ev, max_events=None)))


def _storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.storage_report(spark, {t: f"{sf_dir}/{t}.parquet" for t in samples.TABLES})


_add("storage_report", _storage)
_add("storage_rows", lambda spark, sf_dir: _storage(spark, sf_dir).select("table", "total_rows"))


def _stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "stored-events")
    tables.write_events(samples.web_events(spark, sf_dir), path)
    return lifecycle.read_table(spark, path).select(
        "event_id", "timestamp", "event_month", "website_id", "event_type", "value")


_add("stored_events", _stored_events)


def _bad(pay: DataFrame) -> DataFrame:
    return validate.to_bad(validate.split_good_bad(pay)[1])


_payloads("recent_bad_events", lambda pay: reports.recent_bad_events(_bad(pay), tz=TZ))


def _bad_rate(pay: DataFrame) -> DataFrame:
    result = ingest(pay)
    received = result.events.withColumn("timestamp", F.date_trunc("second", "ingest_time"))
    newest = pay.agg(F.date_trunc("second", F.max("ingest_time"))).scalar()
    return reports.bad_event_rate(result.bad, received, newest, "24 HOURS")


_payloads("bad_event_rate", _bad_rate)

# --- validation ------------------------------------------------------------

_payloads("validate_bad", _bad)
_payloads("bad_event_reasons", lambda pay: validate.bad_event_reasons(_bad(pay)))


def _good(pay: DataFrame) -> DataFrame:
    return validate.parse_events(validate.split_good_bad(pay)[0])


_payloads("validate_good", lambda pay: _good(pay).select(
    "event_id", "timestamp", "website_id", "event_type", "event_name", "client_id", "session_id",
    "url_path", "url_query", "page_title", "referrer", "screen", "language", "transaction_id",
    "currency", "value", "tax", "scroll_depth", "video_percent",
    F.size("items").alias("item_count"), F.size("properties").alias("property_count")))
_payloads("parse_items", lambda pay: _good(pay).select(
    "event_id", F.explode("items").alias("item")).select("event_id", "item.*"))
_payloads("parse_properties", lambda pay: _good(pay).select(
    "event_id", F.explode("properties").alias("key", "value")))
_payloads("ingest_raw", lambda pay: ingest(pay).raw)
_EVENT_DIGEST = (
    "event_id", "timestamp", "website_id", "event_type", "referrer_domain", "utm_source",
    "utm_medium", "utm_campaign", "browser", "browser_version", "os", "device_type", "country")


def _all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event column, with places and the website register; lists as counts."""
    found = ingest(samples.payloads(spark, sf_dir), samples.ip_ranges(spark, sf_dir), samples.websites(spark, sf_dir)).events
    return found.withColumns({"items": F.size("items"), "properties": F.size("properties")}).select(*WIDE)


WIDE = [c for c in EVENTS_SCHEMA.names if c != "is_bot"] + ["event_id"]
_add("ingest_all_columns", _all_columns)
_FOLDERS = ("event_month", "batch_id")
_payloads("ingest_events", lambda pay: ingest(pay).events.select(*_EVENT_DIGEST))


def _replayed(pay: DataFrame) -> DataFrame:
    first = ingest(pay)
    return lifecycle.replay(first.raw).events.select("event_id", "timestamp", "event_type", "value")


_payloads("replay", _replayed)


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, unknown = validate.filter_registered(
        samples.web_events(spark, sf_dir), samples.websites(spark, sf_dir))
    both = known.withColumn("reason", F.lit("")).unionByName(unknown)
    return both.groupBy("website_id", "reason").agg(F.count("*").alias("events"))


_add("filter_registered", _registered)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = samples.web_events(spark, sf_dir).select(
        F.concat(F.lit("key-"), F.substring("client_id", 2, 20)).alias("key"), "timestamp", "event_type")
    return validate.resolve_api_keys(
        requests, samples.api_keys(spark, sf_dir), samples.websites(spark, sf_dir))


_add("resolve_api_keys", lambda spark, sf_dir: _resolved(spark, sf_dir).groupBy(
    "website_id", "domain", "website_name").agg(F.count("*").alias("requests")))
_add("api_key_last_used", lambda spark, sf_dir: validate.api_key_last_used(_resolved(spark, sf_dir)))

# --- enrichment ------------------------------------------------------------


def _page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled page addresses, as referrers and as landing queries."""
    return samples.load(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("referrer"),
        F.concat(F.lit("?"), F.regexp_extract("url", r"[?]([^#]*)", 1)).alias("url_query"))


_add("referrer_domain", lambda spark, sf_dir: enrich.add_referrer_domain(
    _page_urls(spark, sf_dir)).select("page_id", "referrer_domain"))
_add("parse_utm", lambda spark, sf_dir: enrich.parse_utm(
    _page_urls(spark, sf_dir)).drop("referrer", "url_query"))
_web("coalesce_utm", lambda ev: enrich.coalesce_utm(ev).groupBy(
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content").agg(
    F.count("*").alias("events")))
_web("classify_referrer", lambda ev: enrich.classify_referrers(ev).withColumn(
    "strict_class", urls.classify_referrer(F.col("referrer_domain"), strict=True)).groupBy(
    "referrer_domain", "referrer_class", "strict_class").agg(F.count("*").alias("events")))
_web("click_id_attribution", lambda ev: enrich.click_id_attribution(ev).groupBy(
    "click_utm_source", "click_utm_medium").agg(F.count("*").alias("events")))
_payloads("hash_ip", lambda pay: validate.with_ip_hash(pay).select("row_id", "ip_hash"))
_payloads("truncate_ip", lambda pay: pay.select(
    "row_id", identity.truncate_ip(F.col("ip")).alias("ip")))
_add("geo_range_join", lambda spark, sf_dir: enrich.add_geo(
    samples.payloads(spark, sf_dir), samples.ip_ranges(spark, sf_dir)).select(
    "row_id", "ip", "country", "city"))
_add("geo_range_join_shuffled", lambda spark, sf_dir: enrich.add_geo(
    samples.payloads(spark, sf_dir), samples.ip_ranges(spark, sf_dir), max_broadcast_bytes=0).select(
    "row_id", "ip", "country", "city"))
_add("geo_networks", lambda spark, sf_dir: enrich.add_geo_networks(
    samples.payloads(spark, sf_dir).withColumn("ip", F.expr(samples.IPV6)), samples.networks(spark, sf_dir)).select(
    "row_id", "ip", "country", "city"))
_payloads("ua_dim", enrich.build_ua_dim)
_payloads("drop_bots", lambda pay: enrich.drop_bots(pay).groupBy("user_agent").agg(
    F.count("*").alias("requests")))
_payloads("rate_cap", lambda pay: enrich.rate_cap(
    pay.withColumns({"event_id": F.col("row_id"), "ip": F.substring_index("ip", ".", 1)}),
    n=1, window="2 hours").select("row_id", "ip"))
_payloads("hash_session_id", lambda pay: sessions.hash_session_id(pay.select(
    "row_id", "ip", "user_agent", F.lit("site").alias("website_id"),
    F.lit("www.example.com").alias("host"), F.col("ingest_time").alias("timestamp"))).select(
    "row_id", "cookieless_id"))

# --- sessions and tracker jobs ---------------------------------------------

_SESSION_COLUMNS = ("event_id", "website_id", "client_id", "session_no", "session_start")
_web("sessionize", lambda ev: sessions.sessionize(ev).select(*_SESSION_COLUMNS))
_web("sessionize_midnight", lambda ev: sessions.sessionize(ev, split_at_midnight=True).select(
    *_SESSION_COLUMNS))
_web("sessionize_12h", lambda ev: sessions.sessionize(ev, gap_seconds=12 * 3600).select(
    *_SESSION_COLUMNS))
_web("session_table_12h", lambda ev: sessions.session_table(ev, gap_seconds=12 * 3600))
_web("session_starts", lambda ev: sessions.emit_session_starts(ev).select(
    "event_id", "website_id", "client_id", "event_type", "timestamp"))
_web("session_attribution", lambda ev: sessions.session_attribution(ev).select(
    "event_id", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "referrer",
    "gclid", "fbclid", "msclkid", "gad_campaignid", "landing_page"))
_web("dedupe_navigation", lambda ev: sessions.dedupe_navigation(ev).select(
    "event_id", "website_id", "client_id", "session_id", "url_path"))
_add("route_event_type", lambda spark, sf_dir: sessions.route_event_type(
    samples.load(spark, sf_dir, "events").select(F.col("event_type").alias("event_name"))).groupBy(
    "event_name", "event_type").agg(F.count("*").alias("calls")))
_add("split_known_fields", lambda spark, sf_dir: sessions.split_known_fields(
    samples.load(spark, sf_dir, "events").select("event_id", F.create_map(
        F.lit("amount"), F.col("value").cast("string"),
        F.lit("currency"), F.when(F.col("user_id") % 2 == 0, "TRY").otherwise("USD"),
        F.lit("value"), F.concat(F.get_json_object("props", "$.k"), F.lit("x")),
    ).alias("data"))).select(
    "event_id", "currency", "value", "search_term",
    F.array_join(F.map_keys("properties"), ",").alias("property_keys")))


def _datalayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag-manager entries over `part`: half with `ecommerce`, a third no shop event."""
    name = "CASE p_partkey % 3 WHEN 0 THEN 'purchase' WHEN 1 THEN 'view_item' ELSE 'page_view' END"
    item = (
        "concat('{\"id\":\"', CAST(p_partkey AS STRING), '\",\"name\":\"', p_type, '\",\"price\":\"', "
        "CAST(p_size AS STRING), '\"', CASE WHEN p_partkey % 4 = 0 THEN ',\"quantity\":\"3\"' ELSE '' END, '}')"
    )
    shop = f"concat('\"value\":\"', CAST(p_size AS STRING), '.5\",\"currency\":\"TRY\",\"items\":[', {item}, ']')"
    entry = (
        f"concat('{{\"event\":\"', {name}, '\",', CASE WHEN p_partkey % 2 = 0 "
        f"THEN concat('\"ecommerce\":{{', {shop}, '}}') ELSE {shop} END, '}}')"
    )
    return samples.load(spark, sf_dir, "part").selectExpr("p_partkey", f"{entry} AS entry")


_add("normalize_datalayer", lambda spark, sf_dir: sessions.normalize_datalayer(
    _datalayer(spark, sf_dir)).select(
    "p_partkey", "event_type", "event_name", "currency", "value", "tax",
    F.explode("items").alias("item")).select(
    "p_partkey", "event_type", "event_name", "currency", "value", "tax",
    "item.item_id", "item.item_name", "item.item_brand", "item.price", "item.quantity"))

_web("session_table", sessions.session_table)
_web("bounce_rate", sessions.bounce_rate)

# --- panels ----------------------------------------------------------------

_web("traffic_series", panels.traffic_series)
_web("traffic_series_weekly", lambda ev: panels.traffic_series(ev, "week"))
_web("unique_visitors", lambda ev: panels.unique_visitors(ev, "week"))
_web("top_pages", panels.top_pages)
_web("traffic_sources", panels.traffic_sources)
_web("device_share", panels.device_share)
_web("country_share", panels.country_share)


def _scoped(ev: DataFrame) -> DataFrame:
    part = panels.scope(ev, date(2024, 1, 8), date(2024, 1, 15), ["site-0", "site-2"])
    return rollups.daily_stats(part)


_web("scope_filter", _scoped)
_web("realtime", lambda ev: panels.realtime(ev, reports.latest(ev), "6 HOURS"))
_web("scroll_depth_dist", panels.scroll_depth_dist)
_web("web_vitals", panels.web_vitals)

# --- insights --------------------------------------------------------------

_web("funnel", lambda ev: insights.funnel(ev, FUNNEL_STEPS))
_web("funnel_levels_week", lambda ev: insights.funnel_levels(ev, FUNNEL_STEPS, 7 * 86_400))
_web("retention", insights.retention)
_web("retention_daily", lambda ev: insights.retention(ev, "day"))
_web("retention_matrix", lambda ev: insights.retention_matrix(ev))
_web("anomalies", lambda ev: insights.anomalies(rollups.daily_stats(ev)))
_web("anomalies_trailing", lambda ev: insights.anomalies(
    rollups.daily_stats(ev), metric="visitors", mode="trailing", history=7))
_web("pct_change", lambda ev: insights.pct_change(rollups.daily_stats(ev)))
_web("page_movers", insights.page_movers)
_web("new_sources", lambda ev: insights.new_sources(ev.withColumn(
    "referrer_domain", F.concat("client_id", "url_path"))))
_web("device_shift", insights.device_shift)
_web("campaign_performance", insights.campaign_performance)

# --- lifecycle -------------------------------------------------------------


def _retained(ev: DataFrame) -> DataFrame:
    kept = lifecycle.apply_retention(tables.with_month(ev), "bad_events", datetime(2024, 4, 15, 12))
    return kept.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("events"))


_web("apply_retention", _retained)


def _erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lifecycle.erase_clients(samples.web_events(spark, sf_dir), _inactive(spark, sf_dir))
    return rollups.daily_stats(kept)


_add("erase_clients", _erased)


def _inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("client_id"))


def _erased_payloads(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = getattr(ingest(samples.payloads(spark, sf_dir)), table)
        return lifecycle.erase_from_payloads(rows, _inactive(spark, sf_dir))

    return run


_add("erase_raw", _erased_payloads("raw"))
_add("erase_bad", _erased_payloads("bad"))
_add("replay_erased", lambda spark, sf_dir: lifecycle.replay(
    ingest(samples.payloads(spark, sf_dir)).raw, erased=_inactive(spark, sf_dir)).events.select(
    "event_id", "timestamp", "event_type", "client_id"))

# --- streams (run to the end of the stored input) ---------------------------


_KEYS = {name: ("date", "website_id", *spec.keys) for name, spec in rollups.SPECS.items()}


def _stream_rollups(mode: str, late_policy: str = "recompute") -> Query:
    """All nine rollups kept by a stream of three batches, as (rollup, key, measure, value)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = work_dir(spark, f"stream-{mode}")
        for stream in samples.stream_web_batches(spark, sf_dir, f"{out}/source"):
            stream_ingest.stream_rollups(
                stream, f"{out}/events", f"{out}/rollups", f"{out}/checkpoint", trigger=None, mode=mode,
                late_policy=late_policy).awaitTermination()
        found = []
        for name, spec in rollups.SPECS.items():
            rows = stream_ingest.read_rollup(spark, f"{out}/rollups", name, mode)
            key = F.concat_ws("|", *[F.col(k).cast("string") for k in _KEYS[name]])
            measures = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                        for m in (*spec.sums, *spec.distinct)]
            found.append(rows.select(F.lit(name).alias("rollup"), key.alias("key"), F.explode(F.array(*measures)).alias("m"))
                         .select("rollup", "key", "m.*"))
        return functools.reduce(DataFrame.unionByName, found)

    return run


def _stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "stream-daily")
    used = ("event_id", "timestamp", "event_type", "website_id", "client_id", "session_id")
    query = stream_ingest.stream_rollups(
        samples.stream_web_events(spark, sf_dir).select(*used), f"{out}/events", f"{out}/rollups",
        f"{out}/checkpoint", {"daily_stats": rollups.daily_stats}, trigger=None)
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rollups/daily_stats").select(
        "date", "website_id", "pageviews", "visitors", "sessions", "bounces")


def _stream_part(name: str, part: parts.Part, late_policy: str = "recompute") -> Query:
    """A result kept as parts by a stream of three batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = work_dir(spark, name)
        for stream in samples.stream_web_batches(spark, sf_dir, f"{out}/source"):
            parts.run_parts(stream.withColumn("ip_hash", F.col("client_id")), {"result": part}, out,
                            f"{out}/checkpoint", late_policy=late_policy).awaitTermination()
        return parts.read_result(spark, f"{out}/result", part)

    return run


def _stream_updates(name: str, build: Callable[[DataFrame], DataFrame], keys: tuple[str, ...]) -> Query:
    """An aggregation in update mode, its newest row per key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = work_dir(spark, name)
        stream = samples.stream_web_events(spark, sf_dir)
        parts.run_updates(build(stream), keys, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
        return parts.read_result(spark, f"{out}/rows", parts.upserts(keys))

    return run


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed estimates of distinct visitors, and whether they are within 15 % (or 3) of the exact count."""
    estimate = _stream_updates(
        "stream-visitors-approx", lambda ev: windows.windowed_distinct(ev, how="approx"), ("date", "website_id")
    )(spark, sf_dir).withColumnRenamed("visitors", "estimate")
    exact = parts.distinct_clients("exact")
    counted = exact.finish(exact.build(samples.web_events(spark, sf_dir)))
    close = F.abs(F.col("estimate") - F.col("visitors")) <= F.greatest(F.lit(3.0), F.col("visitors") * 0.15)
    return estimate.join(counted, ["date", "website_id"]).select("date", "website_id", "visitors", close.alias("close"))


def _stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "stream-late")
    for stream in samples.stream_web_batches(spark, sf_dir, f"{out}/source"):
        parts.run_parts(stream.select("event_id", "timestamp", "event_type", "website_id"),
                        {"result": parts.daily_windows()}, out, f"{out}/checkpoint",
                        late_policy="side").awaitTermination()
    return parts.read_late(spark, out).select("event_id", "timestamp")


def _stream_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "stream-attribution")
    for stream in samples.stream_web_batches(spark, sf_dir, f"{out}/source"):
        attribution.run_attribution(
            stream.select("event_id", "timestamp", "website_id", "client_id", "session_id", "url_path", "url_query",
                          *UTM_FIELDS, "referrer"),
            out, f"{out}/checkpoint").awaitTermination()
    return attribution.read_attribution(spark, out).select(
        "event_id", "utm_source", "utm_medium", "utm_campaign", "utm_term", "referrer", "landing_page")


def _stream_ingest(table: str) -> Query:
    """The whole collector: stored payload lines, streamed, as one of its three tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = work_dir(spark, f"stream-ingest-{table}")
        payload_source.write_payloads(samples.payloads(spark, sf_dir), f"{out}/lines")
        stream = payload_source.stream_payloads(spark, f"{out}/lines", max_files_per_trigger=4)
        stream_ingest.run_ingest(stream, f"{out}/tables", f"{out}/checkpoint", trigger=None,
                                 rollups={}).awaitTermination()
        return spark.read.parquet(f"{out}/tables/{table}")

    return run


def _stream_to_table(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = work_dir(spark, name)
        query = (
            build(samples.stream_web_events(spark, sf_dir))
            .writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True).start(f"{out}/rows"))
        query.awaitTermination()
        return spark.read.parquet(f"{out}/rows")

    return run


_add("stream_daily_stats", _stream_daily)
for _mode in stream_ingest.MODES:
    _add(f"stream_rollups_{_mode}", _stream_rollups(_mode))
_add("stream_rollups_drop", _stream_rollups("exact", "drop"))
_add("stream_late_rows", _stream_late)
_add("stream_sessions", _stream_part("stream-sessions", parts.session_parts()))
_add("stream_windowed_daily", _stream_part("stream-windowed", parts.daily_windows()))
_add("stream_windowed_daily_update", _stream_updates(
    "stream-windowed-update", windows.windowed_daily, ("date", "website_id")))
_add("stream_windowed_daily_drop", _stream_part("stream-windowed-drop", parts.daily_windows(), "drop"))
_add("stream_windowed_distinct", _stream_to_table("stream-distinct", windows.windowed_distinct))
_add("stream_visitors_exact", _stream_part("stream-visitors-exact", parts.distinct_clients("exact")))
_add("stream_visitors_sketch", _stream_part("stream-visitors-sketch", parts.distinct_clients("sketch")))
_add("stream_visitors_approx", _estimated)
_add("stream_sliding_activity", _stream_part("stream-sliding", parts.sliding_windows()))
_add("stream_rate_flag", _stream_part("stream-rate", parts.rate_windows(1, "1 hour")))
_add("stream_ingest_events", lambda spark, sf_dir: _stream_ingest("events")(spark, sf_dir).select(*_EVENT_DIGEST))
_add("stream_ingest_raw", lambda spark, sf_dir: _stream_ingest("raw_events")(spark, sf_dir).drop(*_FOLDERS))
_add("stream_ingest_bad", lambda spark, sf_dir: _stream_ingest("bad_events")(spark, sf_dir).drop(*_FOLDERS))
_add("stream_dedupe", _stream_to_table(
    "stream-dedupe", lambda ev: windows.dedupe_stream(ev).select("event_id", "event_type")))
_add("stream_attribution", _stream_attribution)
