"""Column functions over addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _host(url: Column) -> Column:
    """Lower-cased host without user and port."""
    place = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), r":\d*$", ""))


def without_prefixes(host: Column, prefixes=("www", "m", "mobile", "wap")) -> Column:
    return reduce(lambda h, p: F.regexp_replace(h, rf"^{p}\.", ""), prefixes, host)


def domain(url: Column) -> Column:
    """Host without www., m., mobile. and wap., one after the other."""
    return without_prefixes(_host(url))


def _query_value(c: Column) -> Column:
    """Decoded and encoded again, as a form would send it."""
    return F.url_encode(F.coalesce(F.try_url_decode(c), c))


def normalize(url: Column) -> Column:
    """The address without tracking parameters, fragment, default port and closing slash; parameters sorted; http as https."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://", 1))
    port = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].rlike(f"(?i){fixed.TRACKING}")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_query_value(p["k"]), F.lit("="), _query_value(p["v"]))), "&")
    whole = F.concat(
        F.when(scheme.isin("http", "https"), F.lit("https")).otherwise(scheme), F.lit("://"), domain(u), F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(F.coalesce(u, F.lit("")) == "", F.lit("")).otherwise(whole)


def key(url: Column) -> Column:
    return F.substring(F.sha1(normalize(url)), 1, 16)


def holds_content(url: Column) -> Column:
    """An http address with none of the parts that hold no content."""
    low = F.lower(F.coalesce(url, F.lit("")))
    bad = F.exists(F.array(*[F.lit(x) for x in fixed.NO_CONTENT]), lambda b: F.contains(low, b))
    return low.rlike("^https?://") & ~bad


def unwrap(url: Column) -> Column:
    """The target in a search page's redirect (base64 after u=a1), else the address itself."""
    code = F.translate(F.try_url_decode(F.regexp_extract(url, "[?&]u=a1([^&]+)", 1)), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    return F.when(F.contains(url, F.lit("bing.com/ck/a")) & (code != ""), F.coalesce(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), url)).otherwise(url)


def same_site(a: Column, b: Column) -> Column:
    """Equal domains, or one a subdomain of the other."""
    under = lambda x, y: F.endswith(x, F.concat(F.lit("."), y))
    return (a != "") & (b != "") & ((a == b) | under(a, b) | under(b, a))


def form_encoded(c: Column) -> Column:
    """Percent-encoded UTF-8 for a form: letters, digits and _.-~ stay, a space is +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def path_encoded(c: Column) -> Column:
    """Percent-encoded UTF-8 that also keeps /; a space is %20."""
    return F.replace(F.replace(form_encoded(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
