"""URL and traffic-source expressions. All are plain JVM expressions, no joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import first_filled

# Domain fragments of each referrer class, tried in this order.
SEARCH_DOMAINS = ("google", "bing", "yahoo", "duckduckgo", "yandex", "baidu", "ecosia")
SOCIAL_DOMAINS = (
    "twitter", "x.com", "facebook", "instagram", "linkedin", "reddit", "youtube", "tiktok",
    "pinterest",
)
EMAIL_DOMAINS = ("mail.google.com", "outlook.live.com", "mail.yahoo.com")

# Ad click ids with the source they stand for, in order of precedence.
CLICK_SOURCES = {"gclid": "google", "fbclid": "facebook", "msclkid": "bing"}

_SCHEME = r"^(?:https?:/*|[a-z][a-z0-9+.-]*://)"
_HOST = _SCHEME + r"(?:[^/?#@\s]*@)?(\[[0-9a-f:.]+\]|[^/:?#\s\[\]]+)(?::(\d*))?(?=[/?#]|$)"


def referrer_domain(referrer: Column) -> Column:
    """Lower-case host without a leading `www.`; '' for a blank or malformed URL."""
    url = F.lower(F.trim(referrer))
    host, port = F.regexp_extract(url, _HOST, 1), F.regexp_extract(url, _HOST, 2)
    bare = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host)
    port_fits = (port == "") | F.coalesce(port.try_cast("long") <= 65535, F.lit(False))
    return F.when(referrer.contains(":") & port_fits, bare).otherwise(F.lit(""))


def _encodable(name: str) -> str:
    """Pattern of a parameter name of which any character may be percent-encoded."""
    def code(c: str) -> str:
        return "%" + "".join(f"[{d}{d.upper()}]" if d.isalpha() else d for d in f"{ord(c):02x}")

    return "".join(f"(?:{c}|{code(c)})" for c in name)


def query_param(query: Column, name: str, length: int = 500) -> Column:
    """First value of a query parameter, URL-decoded; '' when absent.

    The name may be encoded too. What is not valid percent-encoding is kept as written.
    """
    pattern = rf"(?:^[?]{{0,2}}|&){_encodable(name)}(?:=([^&]*))?(?=&|$)"
    raw = F.regexp_extract(query, pattern, 1)
    plain = F.translate(raw, "+", " ")
    encoded = raw.contains("%") | raw.contains("+")
    valid = F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.when(encoded, F.coalesce(F.try_url_decode(valid), plain)).otherwise(raw)
    named = query.contains(name) | query.contains("%")
    return F.when(named, F.left(decoded, F.lit(length))).otherwise(F.lit(""))


def _mentions(domain: Column, names: tuple[str, ...]) -> Column:
    return domain.rlike("|".join(n.replace(".", "[.]") for n in names))


def _belongs_to(domain: Column, names: tuple[str, ...]) -> Column:
    """Exact host or a subdomain of it; bare brand names match as one host label."""
    parts = [n.replace(".", "[.]") + ("$" if "." in n else "[.]") for n in names]
    return domain.rlike("(?:^|[.])(?:" + "|".join(parts) + ")")


def classify_referrer(domain: Column, strict: bool = False) -> Column:
    """Traffic class of a referrer domain: direct, search, social, email or referral.

    The default matches fragments anywhere in the domain, search first, so web mail of
    a search engine counts as search. `strict` compares host labels, email first.
    """
    name = F.lower(domain)
    match = _belongs_to if strict else _mentions
    search = (match(name, SEARCH_DOMAINS), F.lit("search"))
    social = (match(name, SOCIAL_DOMAINS), F.lit("social"))
    email = (match(name, EMAIL_DOMAINS), F.lit("email"))
    order = (email, search, social) if strict else (search, social, email)
    out = F.when((domain == "") | domain.isNull(), F.lit("direct"))
    for condition, label in order:
        out = out.when(condition, label)
    return out.otherwise(F.lit("referral"))


def click_source(query: Column) -> tuple[Column, Column]:
    """(source, medium) of a landing URL, falling back to ad click ids.

    The medium defaults to `cpc` only when the source comes from a click id.
    """
    source = query_param(query, "utm_source")
    medium = query_param(query, "utm_medium")
    by_click = F.lit("")
    for name, label in reversed(CLICK_SOURCES.items()):
        by_click = F.when(query_param(query, name) != "", F.lit(label)).otherwise(by_click)
    from_click = (source == "") & (by_click != "")
    return (
        F.when(from_click, by_click).otherwise(source),
        F.when(from_click, first_filled(medium, F.lit("cpc"))).otherwise(medium),
    )
