"""Client address from request headers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewtide.config import IP_HEADERS

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"


def _ipv6() -> str:
    """Text forms of an IPv6 address: 8 groups, or one ``::`` standing for one or more
    groups, with an optional dotted IPv4 tail that takes the place of two groups."""
    group = "[0-9A-Fa-f]{1,4}"
    forms = [f"({group}:){{7}}{group}", f"({group}:){{6}}{IPV4}"]
    for left in range(0, 8):
        head = f"{group}(:{group}){{{left - 1}}}" if left else ""
        right = 7 - left  # groups that may still follow the gap
        tails = [f"({group}(:{group}){{0,{right - 1}}})?"] if right else [""]
        if right >= 2:
            tails.append(f"({group}:){{0,{right - 2}}}{IPV4}")
        forms += [f"{head}::{tail}" for tail in tails]
    return "|".join(f"({f})" for f in forms)


IPV6 = _ipv6()


def clean_header(value: str) -> str:
    """Plain text of a header: no tags, no percent-encoded bytes, single spaces."""
    plain = f"regexp_replace(regexp_replace({value}, '<[^>]*>', ''), '%[0-9A-Fa-f]{{2}}', '')"
    cleaned = f"trim(regexp_replace({plain}, '[ \\t\\r\\n]+', ' '))"
    return f"CASE WHEN {value} RLIKE '[<% \\t\\r\\n]' THEN {cleaned} ELSE {value} END"


def first_address(value: str) -> str:
    return f"trim(substring_index({clean_header(value)}, ',', 1))"


def is_ip(value: str) -> str:
    """The long IPv6 pattern only runs on text with a colon."""
    v4, v6 = (p.replace("\\", "\\\\") for p in (f"^({IPV4})$", f"^({IPV6})$"))
    return f"CASE WHEN contains({value}, ':') THEN {value} RLIKE '{v6}' ELSE {value} RLIKE '{v4}' END"


def client_ip(headers: str = "headers", keys=IP_HEADERS, default: str = "127.0.0.1") -> Column:
    """First header, by priority, whose first entry is a valid address. Absent headers are
    dropped before any text work."""
    present = f"filter(array({', '.join(f'{headers}[{k!r}]' for k in keys)}), h -> h IS NOT NULL)"
    valid = f"filter(transform({present}, h -> {first_address('h')}), a -> {is_ip('a')})"
    return F.expr(f"coalesce(get({valid}, 0), '{default}')")


def ip_hash(ip: Column) -> Column:
    """Unsigned CRC-32 in base 36, lower case."""
    return F.lower(F.conv(F.crc32(ip).cast("string"), 10, 36))


