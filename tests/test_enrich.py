"""Enrichment on literal values."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from trailmark.functions import identity, text, urls
from trailmark.operators import enrich


def evaluate(spark, value, expression):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expression(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("referrer, domain", [
    ("https://www.Google.com/a", "google.com"), ("not a url", ""), ("", ""), ("http://a.b:8080?x", "a.b"),
    ("https://u:p@shop.example.org/x", "shop.example.org"), ("https://www.www.de#t", "www.de"),
    ("android-app://com.x.y/", "com.x.y"), ("//a.b/c", ""), ("https://a.b/p?q=a b|c", "a.b"),
    ("http://[::1]:80/x", "[::1]"), ("http://a.b:99999/", ""), ("http://a.b:x/", ""), ("http:a.b/c", "a.b"),
    ("https://www." + "a" * 1200 + ".de", "a" * 1200 + ".de"),
])
def test_referrer_domain(spark, referrer, domain):
    assert evaluate(spark, referrer, urls.referrer_domain) == domain


@pytest.mark.parametrize("query, value", [
    ("?utm_source=a%20b&utm_source=c", "a b"), ("utm_source=x+y", "x y"), ("?q=1&utm_source=%zz", "%zz"),
    ("?utm_source", ""), ("?utm_source&utm_source=b", ""), ("?my_utm_source=b", ""), ("", ""),
    ("?a=1&utm_source=%C3%A7", "ç"), ("?utm_source=", ""),
    ("?utm_source=a%20b%zz", "a b%zz"), ("?utm%5Fsource=x", "x"), ("?utm%5fsource=x%", "x%"),
])
def test_query_param(spark, query, value):
    assert evaluate(spark, query, lambda c: urls.query_param(c, "utm_source")) == value


IPV6 = [
    "::", "::1", "1::", "2001:db8::", "fe80::1:2", "1:2:3:4:5:6:7:8", "2001:DB8:0:0:8:800:200C:417A", "1:2:3:4:5:6:7::",
    "::2:3:4:5:6:7:8", "1::2::3", ":1", "1:", "1:2:3", "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "1.2.3.4", "",
    "g::", ":::", "::1:", ":1::", "1:::2", "a:b", "::ffff:0:0",
]


def test_ipv6_bits(spark):
    df = spark.createDataFrame([(t,) for t in IPV6], "ip string").select("ip", identity.ipv6_bits(F.col("ip")).alias("bits"))
    for r in df.collect():
        try:
            expected = f"{int(ipaddress.IPv6Address(r.ip)):0128b}"
        except ValueError:
            expected = None
        assert r.bits == expected, r.ip


def test_longest_network_wins(spark):
    networks = spark.createDataFrame(
        [("2001:db8::/32", "A", ""), ("2001:db8:5::/48", "B", "b"), ("::/1", "C", "c"), ("bad/9", "D", ""), ("1::", "E", ""),
         ("2001:db8::/32", "Z", "")], "network string, country string, city string")
    ips = [("2001:db8:5::9", "B"), ("2001:db8:6::9", "A"), ("7::", "C"), ("ffff::", ""), ("1.2.3.4", ""), ("", ""), (None, "")]
    events = spark.createDataFrame(ips, "ip string, expected string")
    for size in (0, 64 << 20):
        assert all(r.country == r.expected for r in enrich.add_geo_networks(events, networks, size).collect())
    assert {r.country for r in enrich.add_geo_networks(events, networks.limit(0)).collect()} == {""}


@pytest.mark.parametrize("ip, number", [
    ("10.0.3.7", 167772935), ("255.255.255.255", 4294967295), ("10.0.300.7", None), ("10.0.3", None),
])
def test_ipv4_number(spark, ip, number):
    assert evaluate(spark, ip, identity.ipv4_number) == number


@pytest.mark.parametrize("domain, default, strict", [
    ("", "direct", "direct"), ("google.com", "search", "search"), ("mail.google.com", "search", "email"),
    ("netflix.com", "social", "referral"), ("x.com", "social", "social"), ("outlook.live.com", "email", "email"),
    ("m.facebook.com", "social", "social"), ("blog.example.org", "referral", "referral"),
])
def test_classify(spark, domain, default, strict):
    assert evaluate(spark, domain, urls.classify_referrer) == default
    assert evaluate(spark, domain, lambda c: urls.classify_referrer(c, strict=True)) == strict


@pytest.mark.parametrize("query, source, medium", [
    ("?gclid=1", "google", "cpc"), ("?fbclid=1&utm_medium=paid", "facebook", "paid"), ("?msclkid=1", "bing", "cpc"),
    ("?gclid=1&utm_source=news", "news", ""), ("?fbclid=1&gclid=2", "google", "cpc"), ("?utm_medium=m", "", "m"),
])
def test_click_source(spark, query, source, medium):
    assert evaluate(spark, query, lambda c: urls.click_source(c)[0]) == source
    assert evaluate(spark, query, lambda c: urls.click_source(c)[1]) == medium


@pytest.mark.parametrize("agent, expected", [
    ("Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) Version/17.0 Mobile/15E148 Safari/604.1",
     ("Mobile Safari", "17.0", "iOS", "tablet")),
    ("Mozilla/5.0 (Linux; Android 14; Pixel 8) Chrome/120.0.0.0 Mobile Safari/537.36",
     ("Mobile Chrome", "120.0.0.0", "Android", "mobile")),
    ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 OPR/106.0", ("Opera", "106.0", "Windows", "desktop")),
    ("Mozilla/5.0 (SMART-TV; Linux) SamsungBrowser/2.1 Chrome/56.0 TV Safari/537.36",
     ("Samsung Internet", "2.1", "Linux", "desktop")),
    ("", ("Unknown", "", "Unknown", "desktop")),
    (None, ("Unknown", "", "Unknown", "desktop")),
])
def test_device(spark, agent, expected):
    df = enrich.add_device(spark.createDataFrame([(agent,)], "user_agent string"))
    row = df.collect()[0]
    assert (row["browser"], row["browser_version"], row["os"], row["device_type"]) == expected


@pytest.mark.parametrize("agent, bot", [
    ("Googlebot/2.1", True), ("Mozilla/5.0 (compatible; bingbot/2.0)", True), ("curl/8.1", True),
    ("Mozilla/5.0 (Linux; CUBOT X30) Chrome/1", False), ("Mozilla/5.0 Firefox/121.0", False), ("", False),
])
def test_bots(spark, agent, bot):
    assert evaluate(spark, agent, enrich.is_bot) is bot


def test_identity(spark):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    digest = evaluate(spark, "1.2.3.4", lambda c: identity.hash_ip(c, at))
    import hashlib

    assert digest == hashlib.sha256(b"1.2.3.42024-01-02").hexdigest()[:16]
    assert evaluate(spark, "", lambda c: identity.hash_ip(c, at)) == ""
    assert evaluate(spark, "1.2.3.4", identity.truncate_ip) == "1.2.3.0"
    assert evaluate(spark, "1.2.3.4", identity.ipv4_number) == 16909060
    assert evaluate(spark, "::1", identity.ipv4_number) is None


def test_geo_forms_agree_with_brute_force(spark):
    ranges = [(16777216, 16777471, "AU", "x"), (16909060, 16909060, "US", "one"), (33554432, 50331647, "FR", "")]
    ips = ["1.0.0.5", "1.0.1.0", "1.2.3.4", "1.2.3.5", "2.255.0.9", "3.0.0.0", "", "::1"]
    table = spark.createDataFrame(ranges, "lo long, hi long, country string, city string")
    events = spark.createDataFrame([(i,) for i in ips], "ip string")

    def number(ip):
        return sum(int(p) << (24 - 8 * i) for i, p in enumerate(ip.split("."))) if ip.count(".") == 3 else -1

    expected = sorted(
        (ip, *next(((c, t) for lo, hi, c, t in ranges if lo <= number(ip) <= hi), ("", ""))) for ip in ips)
    for bound in (1000, 0):
        got = enrich.add_geo(events, table, max_broadcast_rows=bound)
        assert sorted((r["ip"], r["country"], r["city"]) for r in got.collect()) == expected


@pytest.mark.parametrize("size, shown", [(0, "0.00 B"), (1023, "1023.00 B"), (1536, "1.50 KiB"), (5 << 30, "5.00 GiB")])
def test_readable_size(spark, size, shown):
    df = spark.createDataFrame([(size,)], "n long")
    assert df.select(text.readable_size(F.col("n")).alias("r")).collect()[0]["r"] == shown
