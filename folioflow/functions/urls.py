"""Screen endpoint URLs: a column expression that gives null or the reason for refusal.

The host of a URL may be a name, a dotted quad, one of the short, octal, hex or decimal
spellings of an IPv4 address, or a bracketed IPv6 address. All of them are turned into a
number (IPv4) or a fixed-width hex string (IPv6) with built-in functions, so that the
check is a few range comparisons. Names are not resolved.
"""

from __future__ import annotations

import ipaddress
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import let, strip

NOT_HTTPS = "not_https"
NOT_ALLOWED = "not_allowed"

# Local names, and the special-purpose ranges of the IANA registries that
# are private, reserved, multicast or otherwise not globally reachable, with the parts of
# them that are globally reachable.
LOCAL_NAMES = ("localhost", "localhost.localdomain")
LOCAL_SUFFIXES = (".local", ".internal", ".localhost")
CLOSED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
OPEN_V4 = ("192.0.0.9/32", "192.0.0.10/32")
CLOSED_PRIVATE_V6 = (
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
)
OPEN_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
CLOSED_ALWAYS_V6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3",
    "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9", "ff00::/8",
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_NUMBER = "(?:0x[0-9a-f]+|0[0-7]*|[1-9][0-9]*)"


def _in_any(value: Column, networks: tuple[str, ...], literal) -> Column:
    nets = [ipaddress.ip_network(text) for text in networks]
    bounds = ", ".join(f"struct({literal(n[0])} AS low, {literal(n[-1])} AS high)" for n in nets)
    return F.exists(F.expr(f"array({bounds})"), lambda n: value.between(n["low"], n["high"]))


def decode(url: Column) -> Column:
    """Percent-decoding that keeps ``+`` and stray ``%`` as they are."""
    return F.url_decode(F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def _ipv4_number(host: Column) -> Column:
    """The address a host stands for in any of the classic spellings; null if it is none."""
    token = F.regexp_extract(host, r"^([^ \t\n\x0b\f\r]+)", 1)

    def number(part: Column) -> Column:
        digits = F.regexp_extract(part, "^(?:0x)?0*([0-9a-f]*)$", 1)
        base16, base8 = part.startswith("0x"), part.startswith("0") & (F.length(part) > 1)
        fits = F.length(digits) <= F.when(base16, 8).when(base8, 11).otherwise(10)
        digits = F.when(digits == "", "0").otherwise(digits)
        value = F.when(base16, F.conv(digits, 16, 10)).when(base8, F.conv(digits, 8, 10)).otherwise(digits)
        return F.when(fits, value.cast("bigint"))

    def combine(parts: Column) -> Column:
        n = F.size(parts)
        room = F.when(n == 1, 1 << 32).when(n == 2, 1 << 24).when(n == 3, 1 << 16).otherwise(1 << 8).cast("bigint")
        weight = F.array(*[F.lit(1 << s).cast("bigint") for s in (24, 16, 8)])
        lead = F.slice(parts, 1, n - 1)
        last = F.element_at(parts, -1)
        valid = ~F.exists(parts, lambda p: p.isNull()) & F.forall(lead, lambda p: p <= 255) & (last < room)
        high = F.aggregate(
            F.transform(lead, lambda p, i: p * F.get(weight, i)), F.lit(0).cast("bigint"), lambda a, p: a + p
        )
        return F.when(valid, high + last)

    numeric = token.rlike(rf"^{_NUMBER}(?:\.{_NUMBER}){{0,3}}$")
    return F.when(numeric, let(F.transform(F.split(token, r"\."), number), combine))


def _ipv6_hex(literal: Column) -> Column:
    """The 32 hex digits of an IPv6 literal; null if it is none."""
    # A dotted tail stands for the last two groups.
    quad = F.regexp_extract(literal, rf":({_QUAD})$", 1)

    def widen(q: Column) -> Column:
        octet = lambda i: F.lpad(F.lower(F.hex(F.get(q, F.lit(i)).cast("bigint"))), 2, "0")
        return F.concat(octet(0), octet(1), F.lit(":"), octet(2), octet(3))

    head = F.substring(literal, F.lit(1), F.length(literal) - F.length(quad))
    plain = F.when(quad == "", literal).otherwise(F.concat(head, let(F.split(quad, r"\."), widen)))

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def expand(text: Column) -> Column:
        short = F.contains(text, F.lit("::"))
        left, right = groups(F.substring_index(text, "::", 1)), groups(F.substring_index(text, "::", -1))
        given = F.when(short, F.size(left) + F.size(right)).otherwise(F.size(left))
        filled = F.when(
            short, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
        ).otherwise(left)
        count_ok = F.when(short, given <= 7).otherwise(given == 8)
        digits = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(count_ok, digits)

    shape = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::)?(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"
    return let(plain, lambda text: F.when(text.rlike(shape) & F.contains(text, F.lit(":")), expand(text)))


def _v4_closed(number: Column) -> Column:
    as_int = lambda a: f"{int(a)}L"
    return _in_any(number, CLOSED_V4, as_int) & ~_in_any(number, OPEN_V4, as_int)


def _v6_closed(digits: Column) -> Column:
    as_hex = lambda a: f"'{int(a):032x}'"
    # An address that only wraps an IPv4 address is judged by that one.
    mapped = digits.startswith("0" * 20 + "ffff")
    inner = F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")
    private = _in_any(digits, CLOSED_PRIVATE_V6, as_hex) & ~_in_any(digits, OPEN_V6, as_hex)
    return F.when(mapped, _v4_closed(inner)).otherwise(private | _in_any(digits, CLOSED_ALWAYS_V6, as_hex))


def screen_url(url: Column) -> Column:
    """Null for an acceptable endpoint, else ``not_https`` or ``not_allowed``."""
    controls = "".join(map(chr, range(0x21)))
    clean = F.regexp_replace(F.ltrim(decode(url), F.lit(controls)), "[\\t\\r\\n]", "")
    return let(clean, _screen_decoded)


@lru_cache(1)
def _splitting() -> str:
    """Characters that compatibility normalisation turns into a delimiter of URLs, as a character class.

    A host with one of them is another host to whoever normalises it first.
    """
    found = (chr(c) for c in range(0x80, 0x110000) if set("/?#@:") & set(unicodedata.normalize("NFKC", chr(c))))
    return f"[{''.join(found)}]"


def _screen_decoded(clean: Column) -> Column:
    scheme = F.lower(F.regexp_extract(clean, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(clean, "^[^:]*://([^/?#]*)", 1)

    def judge(netloc: Column) -> Column:
        endpoint = F.regexp_replace(netloc, "^.*@", "")
        bracketed = netloc.rlike(r"[\[\]]")
        inside = F.regexp_extract(endpoint, r"^\[([^\[\]]*)\](?::.*)?$", 1)
        outside = F.substring_index(endpoint, ":", 1)
        host = strip(F.lower(F.when(bracketed, inside).otherwise(outside)))
        named = let(F.struct(host.alias("host"), bracketed.alias("bracketed")), _judge_host)
        return F.when(netloc.rlike(_splitting()), NOT_ALLOWED).otherwise(named)

    return F.when(F.coalesce(scheme, F.lit("")) != "https", NOT_HTTPS).otherwise(let(authority, judge))


def _judge_host(parsed: Column) -> Column:
    host, bracketed = parsed["host"], parsed["bracketed"]
    local = host.isin(*LOCAL_NAMES)
    for suffix in LOCAL_SUFFIXES:
        local = local | host.endswith(suffix)
    literal = F.regexp_extract(host, "^([^%]*)(?:%[^%]+)?$", 1)  # without a zone
    future = host.rlike(r"^v[0-9a-f]+\..+$")

    def by_v6(digits: Column) -> Column:
        return F.when(digits.isNull(), ~future).otherwise(_v6_closed(digits))

    def by_v4(number: Column) -> Column:
        return F.coalesce(_v4_closed(number), F.lit(False))

    closed = F.when(bracketed, let(_ipv6_hex(literal), by_v6)).otherwise(let(_ipv4_number(host), by_v4))
    return F.when((host == "") | local | closed, NOT_ALLOWED)
