"""Candidates for official sources: addresses that lie within what an organisation's registration allows."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validate import sha256, timestamp

#: Query parameters that an official address must not carry.
CREDENTIALS = frozenset(("access_token", "api_key", "apikey", "auth", "authorization", "key", "password", "signature", "token"))
_LABEL = re.compile(r"(?!-)[a-z0-9-]{1,63}(?<!-)")
MOST_EVIDENCE = 10_000_000


def _host(name: str) -> str | None:
    """A DNS name in ASCII, lower case; null for local names, addresses and what is no registrable name."""
    try:
        host = name.rstrip(".").encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None
    parts = host.split(".")
    bad = len(host) > 253 or host.endswith((".localhost", ".local")) or len(parts) < 2 or not all(_LABEL.fullmatch(p) for p in parts)
    return None if bad or all(p.isdigit() for p in parts) else host


def _path(raw: str) -> str | None:
    """A path, decoded once; null if it is relative, climbs, or is encoded twice."""
    path = unquote(raw or "/")
    bad = not path.startswith("/") or "\x00" in path or "\\" in path or {".", ".."} & set(path.split("/")) or re.search("%2f|%5c|%2e", path, re.I)
    return None if bad else path


def _https(url: str | None) -> tuple[str | None, str | None, str | None]:
    if not isinstance(url, str) or not 0 < len(url.strip()) <= 8192:
        return None, None, None
    try:
        u = urlsplit(url.strip())
        port = u.port
    except ValueError:
        return None, None, None
    if u.scheme.lower() != "https" or not u.hostname or u.username is not None or u.password is not None or port not in (None, 443):
        return None, None, None
    host, path, query = _host(u.hostname), _path(u.path), parse_qsl(u.query, keep_blank_values=True)
    if host is None or path is None or any(k.casefold() in CREDENTIALS for k, _ in query):
        return None, None, None
    return f"https://{host}{path}" + (f"?{urlencode(query)}" if query else ""), host, path


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("url", "host", "path")]))
def normalize_https(urls: pd.Series) -> pd.DataFrame:
    """``url``, ``host`` and ``path`` of absolute HTTPS addresses without credentials, odd ports, local or numeric hosts and ambiguous paths; else null. No built-in knows IDNA."""
    return pd.DataFrame([_https(u) for u in urls], columns=["url", "host", "path"])


@F.pandas_udf(T.StringType())
def normalize_host(names: pd.Series) -> pd.Series:
    return names.map(lambda n: _host(n) if isinstance(n, str) else None)


@F.pandas_udf(T.StringType())
def normalize_prefix(prefixes: pd.Series) -> pd.Series:
    """A prefix of paths without a closing slash; the root stays."""
    return prefixes.map(lambda p: (found if (found := _path(p)) in ("/", None) else found.rstrip("/")) if isinstance(p, str) else None)


def rules(registrations: DataFrame) -> DataFrame:
    """Rules in order (``rank``), one row a prefix, each once, of registrations ``organization_id`` and ``rules`` (structs ``hostname``, ``path_prefixes``, ``include_subdomains``)."""
    r = registrations.select(F.lower(F.trim("organization_id")).alias("organization_id"), F.explode("rules").alias("r"))
    r = r.select("organization_id", normalize_host(F.col("r.hostname")).alias("host"), F.coalesce("r.include_subdomains", F.lit(False)).alias("subdomains"), F.explode("r.path_prefixes").alias("p"))
    r = r.select("organization_id", "host", "subdomains", normalize_prefix(F.col("p")).alias("prefix")).where("host is not null and prefix is not null").distinct()
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("organization_id").orderBy("host", "prefix", "subdomains")))


def registration_error(r: DataFrame) -> Column:
    """Why a registration (``organization_id``, ``organization_name``, ``rules``, ``registrar_role``, ``evidence_url``, ``evidence``, ``observed_at``) is refused, or null."""
    words = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    between = lambda c, n: F.coalesce((F.length(words(c)) >= 1) & (F.length(words(c)) <= n), F.lit(False))
    return (
        F.when(~F.coalesce(F.lower(F.trim("organization_id")).rlike(r"^[a-z0-9][a-z0-9._-]{1,79}$"), F.lit(False)), "organization_id").when(~between("organization_name", 300) | ~between("registrar_role", 160), "name_or_role")
        .when(~F.coalesce(F.octet_length("evidence").between(1, MOST_EVIDENCE), F.lit(False)), "evidence").when(normalize_https(F.col("evidence_url"))["url"].isNull(), "evidence_url")
        .when(~F.coalesce(F.size("rules") > 0, F.lit(False)), "rules").when(~timestamp(F.col("observed_at")), "observed_at")
    )


def register(registrations: DataFrame) -> DataFrame:
    """Registrations as records with the digest of their evidence, or with the reason for refusal (``error``). Nothing in them proves control of a domain."""
    out = registrations.withColumn("error", registration_error(registrations))
    return out.withColumns({"evidence_sha256": F.sha2("evidence", 256), "evidence_bytes": F.octet_length("evidence").cast("long"), "identity_verified": F.lit(False), "official_status_verified": F.lit(False)}).drop("evidence")


def load_bundles(spark, path: str) -> DataFrame:
    """Registration bundles (JSON files with the evidence in base64) with ``error``: the contract, the registration's digest over its canonical JSON, and the evidence's length and digest must agree."""
    from ..functions.hashing import canonical_json

    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    v = F.try_parse_json("value")
    r = raw.withColumn("v", v)
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    registration = F.to_json(get("$.registration", "variant"))
    evidence = F.try_to_binary(get("$.evidence_bytes"), F.lit("base64"))
    wrong = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(wrong((get("$.schema_version", "int") == 1) & (get("$.artifact_type") == "manual_official_source_registration_evidence") & (get("$.evidence_encoding") == "base64")), "contract")
        .when(registration.isNull(), "registration").when(wrong(get("$.registration_sha256") == F.sha2(canonical_json(registration), 256)), "registration_sha256")
        .when(wrong((F.octet_length(evidence) == get("$.registration.registration_evidence_byte_length", "long")) & (F.sha2(evidence, 256) == get("$.registration.registration_evidence_sha256"))), "evidence")
    )
    return r.select("file", error.alias("error"), get("$.registration.organization_id").alias("organization_id"), registration.alias("registration"))


def propose(urls: DataFrame, registrations: DataFrame) -> DataFrame:
    """Candidates of ``organization_id``, ``url``, ``title``: the first rule and prefix of the organisation that the address is within, or why there is none (``error``).

    Hosts match as a whole or, where a rule says so, by a dotted suffix; prefixes match whole segments. Rules join by organisation, so the size of either table does not matter."""
    words = F.trim(F.regexp_replace("title", r"\s+", " "))
    u = urls.select(F.monotonically_increasing_id().alias("row_"), F.lower(F.trim("organization_id")).alias("organization_id"), normalize_https(F.col("url")).alias("n"), words.alias("title"))
    known = registrations.select(F.lower(F.trim("organization_id")).alias("organization_id"), F.lit(True).alias("known")).distinct()
    r = rules(registrations)
    held = r.groupBy("organization_id").agg(F.array_sort(F.collect_list(F.struct("rank", "host", "prefix", "subdomains"))).alias("rs"))  # an organisation's rules are few
    j = u.join(known, "organization_id", "left").join(held, "organization_id", "left")
    at = lambda x: ((F.col("n.host") == x["host"]) | (x["subdomains"] & F.col("n.host").endswith(F.concat(F.lit("."), x["host"])))) & ((x["prefix"] == "/") | (F.col("n.path") == x["prefix"]) | F.col("n.path").startswith(F.concat(x["prefix"], F.lit("/"))))
    j = j.withColumn("m", F.get(F.filter("rs", at), F.lit(0)))
    error = F.when(F.col("known").isNull(), "not_registered").when(F.col("n.url").isNull(), "url").when(F.col("m").isNull(), "outside").when(~F.coalesce(F.length("title").between(1, 500), F.lit(False)), "title")
    base = F.to_json(F.struct(F.col("n.host").alias("matched_hostname"), F.col("m.prefix").alias("matched_path_prefix"), F.col("n.url").alias("normalized_url"), "organization_id", "title"))
    return j.select("organization_id", F.col("n.url").alias("url"), "title", error.alias("error"), F.col("n.host").alias("host"), F.col("m.prefix").alias("prefix"), F.sha2("n.url", 256).alias("url_sha256"), F.when(error.isNull(), F.concat(F.lit("official-source:"), F.sha2(base, 256))).alias("evidence_id"), F.lit(False).alias("fetch_permitted"))


def digest_ok(c: Column, digest: Column) -> Column:
    """Whether bytes have the digest that is claimed for them."""
    return sha256(digest) & F.coalesce(F.sha2(c, 256) == digest, F.lit(False))
