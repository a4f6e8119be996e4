"""Pseudonyms for visitors and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_ip(ip: Column, at: Column) -> Column:
    """16 hex digits that link an address within one UTC day only; '' for no address."""
    digest = F.sha2(F.concat(ip, F.date_format(at, "yyyy-MM-dd")), 256)
    return F.when(F.coalesce(ip, F.lit("")) == "", F.lit("")).otherwise(F.left(digest, F.lit(16)))


def truncate_ip(ip: Column) -> Column:
    """IPv4 address with the last octet set to zero."""
    return F.regexp_replace(ip, r"[.]\d+$", ".0")


def cookieless_id(website: Column, host: Column, ip: Column, user_agent: Column, at: Column) -> Column:
    """Visitor id without a cookie; changes every month."""
    month = F.date_format(F.date_trunc("month", at), "yyyy-MM-dd")
    return F.sha2(F.concat_ws("|", website, host, ip, user_agent, month), 256)


_NIBBLES = [f"{n:04b}" for n in range(16)]
_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"


def ipv6_bits(ip: Column) -> Column:
    """IPv6 text as 128 characters 0 and 1; NULL for anything else, dotted tails included."""
    halves = F.split(F.lower(ip), "::")

    def groups(half: Column) -> Column:
        return F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")

    left, right = groups(F.try_element_at(halves, F.lit(1))), groups(F.try_element_at(halves, F.lit(2)))
    gap = F.lit(8) - F.size(left) - F.size(right)
    shape = F.when(F.size(halves) == 1, gap == 0).otherwise(gap >= 1)  # `::` stands for a group at least
    valid = ip.rlike(rf"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$") & shape
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    nibble = F.array(*[F.lit(n) for n in _NIBBLES])
    bits = F.transform(
        F.split(digits, ""), lambda d: F.element_at(nibble, (F.conv(d, 16, 10).cast("int") + 1)))
    return F.when(valid, F.array_join(bits, ""))


def ipv4_number(ip: Column) -> Column:
    """Dotted IPv4 text as a number; NULL for anything else."""
    octets = F.split(ip, "[.]")
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|0?\d?\d)"
    valid = ip.rlike(rf"^(?:{octet}[.]){{3}}{octet}$")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + octets[i].try_cast("long")
    return F.when(valid, number)
