"""URL predicates and canonical forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that identify a caller.
SENSITIVE = ("api_key", "apikey", "email", "key", "mailto", "token")
#: Parameters that stay in a request's identity only as a hash.
OPAQUE = ("webenv", "query_key", "session")


def parts(url: Column) -> dict[str, Column]:
    """scheme, authority, host (lower case), port, path, query and fragment; empty where absent."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    after = F.regexp_extract(authority, r"([^@]*)$", 1)
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "user": F.regexp_extract(authority, r"^(.*)@", 1),
        "host": F.lower(F.regexp_replace(after, r":[0-9]*$", "")),
        "port": F.regexp_extract(after, r":([0-9]+)$", 1),
        "path": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(url, r"#(.*)$", 1),
    }


def sensitive(key: Column) -> Column:
    """Whether a parameter's name marks a credential or contact."""
    k = F.replace(F.lower(F.trim(key)), F.lit("-"), F.lit("_"))
    return k.isin(*SENSITIVE) | k.contains("token") | k.endswith("_api_key") | k.endswith("_email")


def _pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: p != "")


def _name(pair: Column) -> Column:
    return F.split_part(pair, F.lit("="), F.lit(1))


def redact(url: Column) -> Column:
    """The URL without user information and sensitive parameters."""
    p = parts(url)
    query = F.array_join(F.filter(_pairs(p["query"]), lambda x: ~sensitive(_name(x))), "&")
    host = F.concat(p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""))
    return F.concat(p["scheme"], F.lit("://"), host, p["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, sensitive parameters dropped, the others sorted, no fragment."""
    p = parts(url)
    default = ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
    host = F.concat(p["host"], F.when((p["port"] != "") & ~default, F.concat(F.lit(":"), p["port"])).otherwise(""))
    kept = F.filter(_pairs(p["query"]), lambda x: ~sensitive(_name(x)) & ~F.lower(_name(x)).isin(*OPAQUE))
    query = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(_name(x)).alias("k"), x.alias("x")))), lambda s: s["x"]), "&")
    return F.concat(p["scheme"], F.lit("://"), host, F.when(p["path"] == "", "/").otherwise(p["path"]), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def request_key(method: Column, url: Column, accept: Column) -> Column:
    """The identity of a request for caching."""
    opaque = F.array_sort(F.transform(F.filter(_pairs(parts(url)["query"]), lambda x: F.lower(_name(x)).isin(*OPAQUE)), lambda x: F.concat(F.lower(_name(x)), F.lit("="), F.sha2(F.regexp_extract(x, "=(.*)$", 1), 256))))
    types = F.array_join(F.filter(F.transform(F.split(accept, ","), lambda a: F.lower(F.trim(a))), lambda a: a != ""), ",")
    return F.sha2(F.concat_ws("\x1f", F.upper(F.trim(method)), canonical(url), F.when(types == "", "*/*").otherwise(types), F.array_join(opaque, "&")), 256)


def host_matches(host: Column, rule: Column, subdomains: bool = True) -> Column:
    same = host == rule
    return same | host.endswith(F.concat(F.lit("."), rule)) if subdomains else same


def path_matches(path: Column, prefix: Column) -> Column:
    """A prefix matches whole segments only."""
    bare = F.regexp_replace(prefix, "/+$", "")
    return (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def safe_http(url: Column) -> Column:
    """http(s), a host, no user information, no local name and no private, reserved or multicast IPv4 literal."""
    p = parts(url)
    host = F.regexp_replace(p["host"], r"\.+$", "")
    local = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")
    private = host.rlike(r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.[0-9]+\.[0-9]+\.[0-9]+$") | host.rlike(r"^(192\.168|169\.254|198\.1[89]|172\.(1[6-9]|2[0-9]|3[01]))\.")
    return F.coalesce(p["scheme"].isin("http", "https") & (host != "") & (p["user"] == "") & ~local & ~private & ~host.startswith("["), F.lit(False))
