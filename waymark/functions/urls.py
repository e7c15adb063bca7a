"""URL parts and URL policy as columns; unparseable input gives null or a reason, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from waymark import signals
from waymark.functions import scalar as S

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://[^/?#\s]+"
_AUTH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PORT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*(\?[^#]*)"


def parseable(url: Column) -> Column:
    return F.coalesce(url.rlike(_SCHEME), F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def port(url: Column) -> Column:
    return F.regexp_extract(url, _PORT, 1)


def has_credentials(url: Column) -> Column:
    return F.regexp_extract(url, _AUTH, 1).contains("@")


def path(url: Column) -> Column:
    p = F.regexp_extract(url, _PATH, 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def normalize(url: Column) -> Column:
    """Lower scheme and host, no fragment, no trailing slash, query kept."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    body = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
    return F.when(parseable(url), F.concat(scheme(url), F.lit("://"), host(url), body, query(url))).otherwise(url)


def words(text: Column) -> Column:
    """Lowercase ASCII tokens, single spaces, padded, so a phrase test is a plain contains."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.concat(F.lit(" "), cleaned, F.lit(" "))


def segments(url: Column) -> Column:
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))), lambda s: s != "")


def registrable(host_col: Column) -> Column:
    parts = F.filter(F.split(F.lower(host_col), "\\."), lambda p: p != "")
    n = F.size(parts)
    two = F.element_at(parts, F.when(n >= 2, n - 1).otherwise(1)).isin(signals.TWO_PART_SUFFIXES)
    keep = F.when(n <= 2, n).when(two, 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), F.greatest(keep, F.lit(0))), ".")


def host_suffixes(host_col: Column) -> Column:
    """Every label suffix of a host, so a domain match is an equi-join."""
    labels = F.split(host_col, "\\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def non_content_reason(url: Column) -> Column:
    """Why a URL is not a readable page, or null."""
    target = F.lower(F.concat(path(url), query(url)))
    hay = words(target)
    asset = F.get(F.filter(S.str_array(signals.ASSET_SUFFIXES), lambda e: F.endswith(target, e)), F.lit(0))
    mark = F.get(F.filter(S.str_array(signals.INDEX_MARKERS), lambda m: F.contains(hay, F.concat(F.lit(" "), m, F.lit(" ")))), F.lit(0))
    return F.coalesce(
        F.when(~parseable(url), F.lit("unparseable URL")).when(target == "/robots.txt", F.lit(signals.ROBOTS_REASON)),
        F.concat(asset, F.lit(signals.NOT_READABLE)),
        F.concat(F.lit('"'), mark, F.lit(signals.INDEX_PAGE)),
    )


def _is_ip(h: Column) -> Column:
    return h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | h.startswith("[")


def policy_reason(url: Column, allowed: Column) -> Column:
    """First policy a URL breaks, or null; ``allowed`` says whether its host is approved."""
    h = host(url)
    local = (h == "localhost") | h.endswith(".localhost") | h.endswith(".internal") | h.endswith(".local") | _is_ip(h)
    return (
        F.when(~parseable(url), F.lit("unparseable URL"))
        .when(scheme(url) != "https", F.concat(F.lit(signals.ONLY_HTTPS), scheme(url), F.lit(":")))
        .when(has_credentials(url), F.lit(signals.CREDENTIALS))
        .when((port(url) != "") & (port(url) != "443"), F.concat(F.lit(signals.ODD_PORT), port(url)))
        .when(local, F.concat(h, F.lit(signals.NOT_PUBLIC_NAME)))
        .when(~allowed, F.concat(h, F.lit(signals.NOT_APPROVED)))
    )


def domain_reason(domain: Column) -> Column:
    """Why a string is not a plausible public domain, or null."""
    d = F.trim(F.lower(domain))
    shaped = d.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$")
    reserved = S.any_of([(d == bad) | d.endswith(f".{bad}") for bad in signals.RESERVED_DOMAINS])
    return (
        F.when(~shaped, F.lit("not a domain name")).when(d.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.lit("looks like an IP address"))
        .when(reserved, F.lit("not a public domain"))
    )


def variants(url: Column) -> Column:
    """Mechanical www / parent-host rewrites of a URL, without the URL itself."""
    h, p = host(url), path(url)
    tail = F.when(p == "/", F.lit("")).otherwise(p)
    labels = F.split(h, "\\.")
    n, base = F.size(labels), F.size(F.split(registrable(h), "\\."))
    first = F.when(h.startswith("www."), F.regexp_replace(h, "^www\\.", "")).otherwise(F.concat(F.lit("www."), h))
    steps = F.when(n > base, F.sequence(F.lit(1), n - base)).otherwise(F.expr("cast(array() as array<int>)"))
    climbed = F.flatten(F.transform(steps, lambda i: F.array(
        F.array_join(F.slice(labels, i + 1, n - i), "."), F.concat(F.lit("www."), F.array_join(F.slice(labels, i + 1, n - i), ".")),
    )))
    hosts = F.filter(F.array_distinct(F.concat(F.array(first), climbed)), lambda x: x.contains(".") & (x != h))
    return F.transform(hosts, lambda x: F.concat(F.lit("https://"), x, tail))
