"""Enrichment of parsed events: bots, device, traffic source, place, pseudonyms.

User-agent rules run as inline expressions. A join against a table of distinct user
agents would move every wide event row by a key that a single popular browser can
dominate; evaluating the rules in the scan moves nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import identity, text, urls
from trailmark.operators.ranking import top_rows
from trailmark.schema import UTM_FIELDS


class UserAgentRule(NamedTuple):
    """The first rule of a kind that fits a user agent gives the name.

    A rule fits when the agent contains one of `any_of`, all of `all_of` and none of
    `none_of`. Plain substring tests cost a fraction of a pattern match. The version is
    the run of digits and dots after the first token found.
    """

    kind: str
    name: str
    any_of: tuple[str, ...]
    all_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()


# User-agent tokens, in order of precedence within each kind.
DEVICE_RULES = (
    UserAgentRule("browser", "Edge", ("Edg/", "EdgA/", "EdgiOS/", "Edge/")),
    UserAgentRule("browser", "Opera", ("OPR/", "OPiOS/", "Opera/")),
    UserAgentRule("browser", "Samsung Internet", ("SamsungBrowser/",)),
    UserAgentRule("browser", "Yandex", ("YaBrowser/",)),
    UserAgentRule("browser", "UCBrowser", ("UCBrowser/",)),
    UserAgentRule("browser", "Mobile Firefox", ("FxiOS/",)),
    UserAgentRule("browser", "Mobile Firefox", ("Firefox/",), ("Android",)),
    UserAgentRule("browser", "Firefox", ("Firefox/",)),
    UserAgentRule("browser", "Mobile Chrome", ("CriOS/",)),
    UserAgentRule("browser", "Mobile Chrome", ("Chrome/",), (" Mobile",)),
    UserAgentRule("browser", "Chrome", ("Chrome/",)),
    UserAgentRule("browser", "Mobile Safari", ("Version/",), (" Mobile", "Safari/")),
    UserAgentRule("browser", "Safari", ("Version/",), ("Safari/",)),
    UserAgentRule("browser", "IE", ("MSIE ", "rv:"), (), ("Gecko/",)),
    UserAgentRule("os", "Windows", ("Windows",)),
    UserAgentRule("os", "iOS", ("iPhone", "iPad", "iPod")),
    UserAgentRule("os", "macOS", ("Mac OS X", "Macintosh")),
    UserAgentRule("os", "Android", ("Android",)),
    UserAgentRule("os", "Chrome OS", ("CrOS",)),
    UserAgentRule("os", "Ubuntu", ("Ubuntu",)),
    UserAgentRule("os", "Linux", ("Linux",)),
    UserAgentRule("device", "smarttv", ("SmartTV", "SMART-TV", "AppleTV", "GoogleTV", "HbbTV")),
    UserAgentRule("device", "console", ("PlayStation", "Xbox", "Nintendo")),
    UserAgentRule("device", "tablet", ("iPad", "Tablet", "PlayBook", "Silk/")),
    UserAgentRule("device", "tablet", ("Android",), (), ("Mobile",)),
    UserAgentRule("device", "mobile", ("iPhone", "iPod", "Mobile", "BlackBerry")),
)

# Lower-case fragments that mark crawlers and scripted clients, and
# fragments of device names that only look like one.
BOT_TOKENS = (
    "bot", "crawl", "spider", "slurp", "archiver", "facebookexternalhit", "headless",
    "lighthouse", "pingdom", "preview", "scrap", "phantomjs", "selenium", "puppeteer", "curl/",
    "wget/", "python-", "java/", "go-http-client", "okhttp", "axios/", "node-fetch", "libwww",
    "httpclient",
)
BOT_EXCEPTIONS = ("cubot",)


def _contains_any(text_: Column, tokens: Sequence[str]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | text_.contains(token)
    return found


def is_bot(
    user_agent: Column,
    tokens: Sequence[str] = BOT_TOKENS,
    exceptions: Sequence[str] = BOT_EXCEPTIONS,
) -> Column:
    """True when the user agent contains a token, ignoring case."""
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    return _contains_any(agent, tokens) & ~_contains_any(agent, exceptions)


def drop_bots(
    events: DataFrame, tokens: Sequence[str] = BOT_TOKENS, keep: bool = False
) -> DataFrame:
    """Rows of people only; `keep` marks bots in `is_bot` instead of dropping them."""
    bot = is_bot(F.col("user_agent"), tokens)
    return events.withColumn("is_bot", bot) if keep else events.filter(~bot)


def device_class(device: Column) -> Column:
    """mobile, tablet, or desktop for everything else."""
    return F.when(device.isin("mobile", "tablet"), device).otherwise(F.lit("desktop"))


def _fits(agent: Column, rule: UserAgentRule) -> Column:
    fits = _contains_any(agent, rule.any_of)
    for token in rule.all_of:
        fits = fits & agent.contains(token)
    return fits & ~_contains_any(agent, rule.none_of)


def _first_fit(agent: Column, rules: Sequence[UserAgentRule], default: str) -> Column:
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(_fits(agent, rule), F.lit(rule.name)).otherwise(out)
    return out


def _version(agent: Column, rules: Sequence[UserAgentRule]) -> Column:
    out = F.lit("")
    for rule in reversed(rules):
        tokens = "|".join(t.replace(".", "[.]") for t in rule.any_of)
        version = F.regexp_extract(agent, rf"(?:{tokens})([\d.]+)", 1)
        out = F.when(_fits(agent, rule), version).otherwise(out)
    return out


def add_device(events: DataFrame, rules: Sequence[UserAgentRule] = DEVICE_RULES) -> DataFrame:
    """Add `browser, browser_version, os, device_type` from `user_agent`."""
    agent = F.coalesce("user_agent", F.lit(""))
    by_kind = {kind: [r for r in rules if r.kind == kind] for kind in ("browser", "os", "device")}
    return events.withColumns({
        "browser": _first_fit(agent, by_kind["browser"], "Unknown"),
        "browser_version": _version(agent, by_kind["browser"]),
        "os": _first_fit(agent, by_kind["os"], "Unknown"),
        "device_type": device_class(_first_fit(agent, by_kind["device"], "")),
    })


def build_ua_dim(events: DataFrame, rules: Sequence[UserAgentRule] = DEVICE_RULES) -> DataFrame:
    """One row per distinct user agent with its device columns and number of events."""
    agents = events.groupBy("user_agent").agg(F.count("*").alias("events"))
    return add_device(agents, rules)


def add_referrer_domain(events: DataFrame) -> DataFrame:
    return events.withColumn("referrer_domain", urls.referrer_domain(F.col("referrer")))


def parse_utm(events: DataFrame) -> DataFrame:
    """Add `query_utm_*`, the campaign parameters found in `url_query`."""
    return events.withColumns(
        {f"query_{name}": urls.query_param(F.col("url_query"), name) for name in UTM_FIELDS}
    )


def coalesce_utm(events: DataFrame) -> DataFrame:
    """Fill blank campaign columns from the query; a sent value wins."""
    return events.withColumns({
        name: text.first_filled(F.col(name), urls.query_param(F.col("url_query"), name))
        for name in UTM_FIELDS
    })


def click_id_attribution(events: DataFrame) -> DataFrame:
    """Add `click_utm_source, click_utm_medium` of the landing query."""
    source, medium = urls.click_source(F.col("url_query"))
    return events.withColumns({"click_utm_source": source, "click_utm_medium": medium})


def classify_referrers(events: DataFrame, strict: bool = False) -> DataFrame:
    return events.withColumn(
        "referrer_class", urls.classify_referrer(F.col("referrer_domain"), strict)
    )


_PREFIX_BITS = 16


def prefix_ranges(ip_ranges: DataFrame) -> DataFrame:
    """Ranges repeated for each 16-bit prefix they touch (at most 65,536 in all space)."""
    return ip_ranges.withColumn(
        "ip_prefix",
        F.explode(F.sequence(F.shiftright("lo", _PREFIX_BITS), F.shiftright("hi", _PREFIX_BITS))),
    )


BROADCAST_BYTES = 64 << 20


def _small(df: DataFrame, max_bytes: int) -> bool:
    """Whether the plan's own statistics put a table within the bound; reads no data."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= max_bytes


def add_geo_networks(
    events: DataFrame, networks: DataFrame, max_broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Add `country, city` of the IPv6 address; '' when no network holds it.

    `networks(network, country, city)` has texts like `2001:db8::/32`; of nested ones the
    longest counts. An address is looked up under its leading bits, once per prefix length
    that the table has (128 at most), by an equi join. Only distinct addresses are looked
    up; a table within the bound is broadcast.
    """
    parts = F.split("network", "/")
    keyed = (
        networks.withColumn("_length", F.try_element_at(parts, F.lit(2)).try_cast("int"))
        .withColumn("_prefix", F.left(identity.ipv6_bits(F.element_at(parts, 1)), F.col("_length")))
        .where(F.col("_length").between(1, 128) & F.col("_prefix").isNotNull())
        .groupBy("_length", "_prefix").agg(F.min(F.struct("country", "city")).alias("_place"))
    )
    lengths = sorted(r["_length"] for r in keyed.select("_length").distinct().collect())
    base = events.drop("country", "city")
    if not lengths:
        return base.withColumns({"country": F.lit(""), "city": F.lit("")})
    table = F.broadcast(keyed) if _small(networks, max_broadcast_bytes) else keyed
    bits = base.select("ip").distinct().withColumn("_bits", identity.ipv6_bits(F.col("ip"))).where("_bits is not null")
    looked = bits.withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths]))).select(
        "ip", "_length", F.left("_bits", F.col("_length")).alias("_prefix"))
    places = looked.join(table, ["_length", "_prefix"]).groupBy("ip").agg(F.max_by("_place", "_length").alias("_place"))
    located = base.join(places, "ip", "left").withColumns(
        {c: F.coalesce(f"_place.{c}", F.lit("")) for c in ("country", "city")})
    return located.select(*base.columns, "country", "city")


def add_geo(
    events: DataFrame, ip_ranges: DataFrame, max_broadcast_bytes: int = BROADCAST_BYTES,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Add `country, city` of the IPv4 address; '' when no range holds it.

    `ip_ranges(lo, hi, country, city)` must not overlap. The range join becomes an equi
    join on the address prefix. By its size in the plan, a range table within the bound is
    broadcast and events do not move (prefixes add 65,536 rows at most); beyond it, only the
    distinct addresses are matched and the result is joined back on `ip`, where adaptive
    execution splits a hot address. `max_broadcast_rows` bounds its rows as well, which reads
    at most one row more than that.
    """
    ranges = prefix_ranges(ip_ranges)
    number = identity.ipv4_number(F.col("ip"))
    matches = (F.col("ip_number") >= F.col("lo")) & (F.col("ip_number") <= F.col("hi"))
    fill = {"country": F.coalesce("country", F.lit("")), "city": F.coalesce("city", F.lit(""))}

    def located(addresses: DataFrame, table: DataFrame) -> DataFrame:
        keyed = addresses.withColumn("ip_number", number)
        prefix = F.shiftright("ip_number", _PREFIX_BITS)
        joined = keyed.join(table, (prefix == F.col("ip_prefix")) & matches, "left")
        return joined.drop("ip_prefix", "ip_number", "lo", "hi")

    base = events.drop("country", "city")
    few = max_broadcast_rows is None or ip_ranges.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    if few and _small(ip_ranges, max_broadcast_bytes):
        return located(base, F.broadcast(ranges)).withColumns(fill)
    places = located(base.select("ip").distinct(), ranges)
    return base.join(places, "ip", "left").withColumns(fill)


def enrich(events: DataFrame, ip_ranges: DataFrame | None = None) -> DataFrame:
    """All enrichments of parsed events, in the collector's order."""
    out = coalesce_utm(add_referrer_domain(add_device(events)))
    if ip_ranges is None:
        return out.withColumns({"country": F.lit(""), "city": F.lit("")})
    return add_geo(out, ip_ranges)


def rate_cap(requests: DataFrame, n: int = 60, window: str = "60 seconds") -> DataFrame:
    """At most `n` requests per address in each time window, oldest first.

    The limit is the feature. Requests without an address are nobody's and all pass. A
    flood from one address is cut before its last shuffle, whatever `n` is (see `ranking`).
    """
    known = F.coalesce(F.col("ip") != "", F.lit(False))
    slotted = requests.withColumns({
        "slot": F.window("ingest_time", window)["start"],
        "caller": F.when(known, F.col("ip")).otherwise(F.concat(F.lit("|"), F.col("event_id").cast("string"))),
    })
    order = [F.col("ingest_time"), F.col("event_id")]
    return top_rows(slotted, ["caller", "slot"], order, n, "rank_in_window", "event_id").drop("slot", "caller")
