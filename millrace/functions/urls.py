"""URL functions: normal forms, safety checks."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, quote_plus, unquote, unquote_to_bytes, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from millrace.functions.text import bound, trimmed
from millrace.session import shipped

# Query keys that only track, and prefixes of such keys.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")
TRACKING_PREFIXES = ("utm_", "_hs")
# Address ranges that are not public besides the well-known private ones.
NON_PUBLIC = ("100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "2001:db8::/32")
LONGEST = 2048

PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: What the native form handles: plain host, maybe a port, no escapes in the query.
SIMPLE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[A-Za-z0-9.\-]+(:[0-9]{1,5})?(/[A-Za-z0-9._~/\-]*)?(\?[A-Za-z0-9._~=&\-]*)?(#[^\s%\p{Cntrl}]*)?\z"
#: What no URL may hold: control characters and broken escapes; and what no host may.
BROKEN = re.compile(r"[\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})")
BROKEN_HOST = re.compile(r"[\\^`{|}@\s]|%(?!25|[89A-Fa-f])")
#: Paths that stay as they are written; others are decoded and escaped anew.
ESCAPED_PATH = re.compile(r"[A-Za-z0-9\-_.~!$&'()*+,;=:@/\[\]%]*")


def tracking(key: Column) -> Column:
    key = F.lower(key)
    found = key.isin(*TRACKING_KEYS)
    for prefix in TRACKING_PREFIXES:
        found = found | key.startswith(prefix)
    return found


def normal_simple(url: Column) -> Column:
    """Normal form of an https URL that SIMPLE matches; null for others: lower-case host, no default port, fragment or
    lone slash, query pairs without tracking sorted by key (stable among equal keys)."""
    # what SIMPLE matches has no control characters
    parts = lambda u: F.split(F.regexp_replace(u, PARTS, "$1\x00$2\x00$3\x00$4"), "\x00")
    return bound(trimmed(url), lambda u: F.when(u.rlike(SIMPLE), bound(parts(u), lambda p: joined_parts(*[F.get(p, k) for k in range(4)]))))


def joined_parts(scheme: Column, place: Column, rest: Column, asked: Column) -> Column:
    """Normal form of an https URL's scheme, host with port, path and query; null for other schemes or ports."""
    host = F.regexp_replace(F.lower(place), ":443$", "")
    port = F.regexp_extract(place, ":([0-9]+)$", 1)
    pairs = F.filter(F.split(asked, "&"), lambda p: p != "")
    # the place keeps pairs of one key in order
    keyed = F.transform(pairs, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), i.alias("at"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("pair")))
    kept = F.transform(F.array_sort(F.filter(keyed, lambda k: ~tracking(k["key"]))), lambda k: k["pair"])
    query = bound(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(""))
    path = F.when(rest == "/", "").otherwise(rest)
    fine = (F.lower(scheme) == "https") & ((port == "") | F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False)))
    return F.when(fine, F.concat(F.lit("https://"), host, path, query))


def normal_form(raw: str | None) -> str | None:
    """Normal form of any https URL, or None. Escapes in a query and what is not ASCII are escaped anew, in UTF-8."""
    raw = (raw or "").strip()
    if BROKEN.search(raw):
        return None
    try:
        u = urlsplit(raw)
        port = u.port
    except ValueError:
        return None
    host = unquote(u.hostname or "").lower()
    if u.scheme.lower() != "https" or not host or BROKEN_HOST.search(u.netloc) or (port is not None and not 1 <= port <= 65535) or ";" in u.query:
        return None
    pairs = [tuple(unquote_to_bytes(x.replace("+", " ")) for x in p.partition("=")[::2]) for p in u.query.split("&") if p]
    pairs = [p for p in pairs if not (key := p[0].decode(errors="replace").lower()).startswith(TRACKING_PREFIXES) and key not in TRACKING_KEYS]
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(pairs, key=lambda p: p[0]))
    place = quote(host, safe="!$&'()*+,;=:[]<>\"")
    place = f"[{place}]" if ":" in host else place
    if port is not None and port != 443:
        place += f":{port}"
    path = "" if u.path == "/" else u.path if ESCAPED_PATH.fullmatch(u.path) else quote(unquote_to_bytes(u.path), safe="$&+,/:;=@")
    return f"https://{place}{path}" + (f"?{query}" if query else "")


@shipped
@F.pandas_udf(StringType())
def normal_any(url: pd.Series) -> pd.Series:
    return url.map(normal_form, na_action="ignore")


def normal_url(url: Column) -> Column:
    """Normal form, or null where the URL is rejected: natively for simple URLs, others go to an Arrow UDF."""
    simple = trimmed(url).rlike(SIMPLE)
    return F.when(simple, normal_simple(url)).otherwise(normal_any(F.when(~simple, url)))


def reject_reason(url: Column) -> Column:
    """Why a URL is not a safe https URL; null where it is."""
    return bound(trimmed(F.coalesce(url, F.lit(""))), lambda u: bound(F.regexp_extract(u, PARTS, 2), lambda place: fault(u, place)))


def fault(u: Column, place: Column) -> Column:
    """reject_reason() of a trimmed URL, given the place that PARTS finds in it: empty where it does not match."""
    return (
        F.when(u == "", "missing")
        .when(F.octet_length(u) > LONGEST, "too_long")
        .when(place == "", "malformed")
        .when(F.lower(F.substring_index(u, "://", 1)) != "https", "not_https")
        .when(place.contains("@"), "userinfo")
    )


def host_of(url: Column) -> Column:
    """Lower-case host and port."""
    return F.lower(F.regexp_extract(trimmed(url), PARTS, 2))


def allowed_host(url: Column, hosts: list[str]) -> Column:
    return reject_reason(url).isNull() & host_of(url).isin(*hosts)


def public_address(address: str | None) -> bool:
    try:
        ip = ipaddress.ip_address((address or "").strip("[]"))
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_unspecified or str(ip) == "255.255.255.255":
        return False
    return not any(ip in ipaddress.ip_network(n) for n in NON_PUBLIC if ipaddress.ip_network(n).version == ip.version)


@shipped
@F.pandas_udf(BooleanType())
def is_public_address(address: pd.Series) -> pd.Series:
    return address.map(public_address).astype(bool)


LITERAL = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"


def public_url(url: Column) -> Column:
    """A safe https URL whose host is not local. Address literals are looked at in an Arrow UDF, names natively."""
    def looked_at(u: Column, place: Column, host: Column) -> Column:
        named = (host != "") & (host != "localhost") & ~host.endswith(".localhost") & ~host.endswith(".local")
        return F.struct((fault(u, place).isNull() & named).alias("safe"), F.when(host.rlike(LITERAL), host).alias("literal"))

    host = lambda place: F.regexp_replace(F.regexp_replace(F.lower(place), ":[0-9]+$", ""), r"\.$", "")
    seen = bound(trimmed(F.coalesce(url, F.lit(""))), lambda u: bound(F.regexp_extract(u, PARTS, 2), lambda place: bound(host(place), lambda h: looked_at(u, place, h))))
    # what a UDF is given has no lambda; a literal begins with a bracket or a digit
    asked = F.when(F.coalesce(url, F.lit("")).rlike(r"://[\[0-9]"), host(host_of(url)))
    return seen["safe"] & (seen["literal"].isNull() | is_public_address(asked))
