"""Lawful access by an institution's profile: platforms by DOI prefix or host, routes, sign-in pages and checklists."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import parts
from ..functions.validate import PROFILE_SECRETS, InvalidInput

#: Fixed value: how many articles may be opened by hand in one go.
INTERACTIVE_MOST = 20
COLUMNS = ("title", "doi", "pmid", "landing_url", "platform", "route", "entry_url")


def _check_url(value: object, where: str) -> str:
    from urllib.parse import urlsplit

    if not isinstance(value, str) or urlsplit(value).scheme not in ("http", "https") or urlsplit(value).username or urlsplit(value).password:
        raise InvalidInput(f"{where}: an http(s) address without credentials is required")
    return value


def _check_keys(data: object, where: str = "profile") -> None:
    pairs = data.items() if isinstance(data, dict) else enumerate(data) if isinstance(data, list) else ()
    for key, value in pairs:
        if isinstance(key, str) and any(p in key.lower().replace("-", "_") for p in PROFILE_SECRETS):
            raise InvalidInput(f"{where}.{key}: a profile holds no credentials or accounts")
        _check_keys(value, f"{where}.{key}")


def parse_profile(data: object) -> dict:
    """A profile that is in order: ``institution``, ``platforms`` and addresses; raises otherwise."""
    if not isinstance(data, dict):
        raise InvalidInput("a profile is an object")
    _check_keys(data)
    if not isinstance(data.get("institution"), str) or not data["institution"].strip():
        raise InvalidInput("profile.institution is required")
    platforms = []
    for i, p in enumerate(data.get("platforms") or []):
        if not isinstance(p, dict) or not isinstance(p.get("name"), str):
            raise InvalidInput(f"profile.platforms[{i}]: a name is required")
        platforms.append({"name": p["name"], "entry_url": _check_url(p.get("entry_url"), f"profile.platforms[{i}].entry_url"), "doi_prefixes": [str(x) for x in p.get("doi_prefixes") or []], "hosts": [str(x).lower() for x in p.get("hosts") or []]})
    out = {"institution": data["institution"].strip(), "platforms": platforms}
    for key in ("webvpn_portal", "document_delivery", "federation_discovery"):
        out[key] = _check_url(data[key], f"profile.{key}") if data.get(key) is not None else None
    if data.get("federation_entity_id") is not None and not isinstance(data["federation_entity_id"], str):
        raise InvalidInput("profile.federation_entity_id is a text")
    return out


def load_profile(spark: SparkSession, path: str | None) -> dict | None:
    """The profile in a file of any file system that the session reads, or none."""
    if not path:
        return None
    text = spark.read.text(path, wholetext=True).first()
    try:
        return parse_profile(json.loads(text.value if text else ""))
    except json.JSONDecodeError as bad:
        raise InvalidInput(f"not JSON: {path}") from bad


def platforms(spark: SparkSession, profile: dict) -> DataFrame:
    """``rank``, ``name``, ``entry_url``, ``kind`` (doi or host) and ``value`` of a profile's rules. A profile is small: it came as one document."""
    rows = [(i, p["name"], p["entry_url"], kind, v) for i, p in enumerate(profile["platforms"]) for kind, vs in (("doi", [x.rstrip("/").lower() + "/" for x in p["doi_prefixes"]]), ("host", p["hosts"])) for v in vs]
    return spark.createDataFrame(rows, "rank int, name string, entry_url string, kind string, value string")


def landing(doi: Column, given: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.when(F.trim(doi) != "", F.concat(F.lit("https://doi.org/"), F.trim(doi))), F.lit(""))


def plan(rows: DataFrame, profile: dict | None) -> DataFrame:
    """``COLUMNS`` of rows ``seq``, ``title``, ``doi``, ``pmid``, ``landing_url`` (and ``seq``): the first platform of the profile whose DOI prefix or, failing that, host the record has; else a portal, delivery, or the DOI alone.

    A row meets a platform by equality: by each prefix of its DOI that ends in a slash, and by each suffix of its host."""
    spark = rows.sparkSession
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    r = rows.select("seq", F.coalesce("title", F.lit("")).alias("title"), blank("doi").alias("doi"), F.coalesce("pmid", F.lit("")).alias("pmid"), landing(blank("doi"), blank("landing_url")).alias("landing_url"))
    if profile is None:
        return r.select("*", F.lit("").alias("platform"), F.lit("no_profile").alias("route"), F.lit("").alias("entry_url"))
    segments = F.split(F.lower("doi"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda k: F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/")))
    labels = F.split(parts(F.col("landing_url"))["host"], r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    keys = F.concat(F.when(F.size(segments) > 1, F.transform(prefixes, lambda v: F.struct(F.lit("doi").alias("kind"), v.alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")), F.transform(hosts, lambda v: F.struct(F.lit("host").alias("kind"), v.alias("value"))))
    hits = r.select("seq", F.explode(keys).alias("k")).select("seq", "k.*").join(F.broadcast(platforms(spark, profile)), ["kind", "value"])  # one document's rules
    best = hits.groupBy("seq").agg(F.min(F.struct("rank", "name", "entry_url")).alias("m"))
    portal, delivery = profile.get("webvpn_portal"), profile.get("document_delivery")
    other = ("webvpn_then_doi", portal) if portal else ("document_delivery", delivery) if delivery else ("doi_only", "")
    r = r.join(best, "seq", "left")
    hit = F.col("m").isNotNull()
    return r.select("seq", "title", "doi", "pmid", "landing_url", F.coalesce("m.name", F.lit("")).alias("platform"), F.when(hit, "federated_login").otherwise(other[0]).alias("route"), F.when(hit, F.col("m.entry_url")).otherwise(other[1]).alias("entry_url"))


def login_pages(planned: DataFrame) -> DataFrame:
    """Sign-in pages in the order in which rows first need them: ``entry_url``, ``name``, ``first_seq``."""
    need = planned.where(F.col("route").isin("federated_login", "webvpn_then_doi"))
    return need.groupBy("entry_url").agg(F.min(F.struct("seq", F.when(F.col("route") == "federated_login", F.col("platform")).otherwise("WebVPN").alias("name"))).alias("f")).select("entry_url", "f.name", F.col("f.seq").alias("first_seq"))


def route_counts(planned: DataFrame) -> DataFrame:
    return planned.groupBy("route").count()


def interactive(planned: DataFrame) -> DataFrame:
    """The first articles that one would open by hand."""
    return planned.orderBy("seq").limit(INTERACTIVE_MOST)


def read_needs(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated list with a header, as texts; blank lines are left out."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").option("ignoreLeadingWhiteSpace", False).csv(path)


def write_checklist(planned: DataFrame, path: str) -> None:
    planned.select(*(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]+", " ").alias(c) for c in COLUMNS)).write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def html_rows(planned: DataFrame) -> DataFrame:
    """One list item a row, escaped; ``seq`` keeps the order."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    sign_in = F.when((F.col("entry_url") != "") & (F.col("route") == "federated_login"), F.concat(F.lit('<a href="'), esc("entry_url"), F.lit('">Sign in: '), esc("platform"), F.lit("</a>")))
    article = F.when(F.col("landing_url") != "", F.concat(F.lit('<a href="'), esc("landing_url"), F.lit('">Article</a>')))
    meta = F.concat_ws(" | ", F.when(F.col("doi") != "", F.concat(F.lit("DOI "), esc("doi"))), F.when(F.col("pmid") != "", F.concat(F.lit("PMID "), esc("pmid"))), "route")
    return planned.select("seq", F.concat(F.lit("<li>"), esc("title"), F.lit(" <small>"), meta, F.lit("</small> "), F.concat_ws(" ", sign_in, article), F.lit("</li>")).alias("value"))


def html_page(items: list[str], institution: str) -> str:
    """A page of a checklist's items; meant for lists that people read."""
    return f"<!doctype html><meta charset='utf-8'><title>{escape(institution)}</title><h1>{escape(institution)}</h1><ol>{''.join(items)}</ol>"


def decisions(records: DataFrame, locations: DataFrame) -> DataFrame:
    """Where each record (``key``, ``title``, ``doi``, ``pmid``, ``pmcid``, ``access``, ``license``) may lawfully be read: ``category``, ``route``, ``url``, ``landing_url``, ``used_license``, ``note``.

    An open record of the full-text archive comes first, if its licence lets machines read it; then the best open location (``locations``: ``doi``, ``url``, ``landing_url``,
    ``license``, ``version``), if its does; else the link of whichever there is, the archive's before the other. Without any, access goes through the DOI's page, or the PMID's."""
    from ..functions.policy import assess_license
    from ..functions.text import normalize_doi

    archive_url = F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/"), "pmcid", F.lit("/fullTextXML"))
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    loc = locations.select(normalize_doi(F.col("doi")).alias("l_doi"), F.col("url").alias("l_url"), F.col("landing_url").alias("l_landing"), F.col("license").alias("l_license")).dropDuplicates(["l_doi"])
    r = records.withColumn("doi", normalize_doi(F.col("doi"))).join(loc, F.col("doi") == F.col("l_doi"), "left")
    first = there("pmcid") & (F.col("access") == "open")
    first_ok = first & (assess_license(archive_url, F.col("license")) == "allowed_machine_read")
    second = there("l_url")
    second_ok = second & (assess_license(F.col("l_url"), F.col("l_license")) == "allowed_machine_read")
    category = F.when(first_ok | second_ok, "oa_machine_readable").when(first | second, "oa_link_only").when(there("doi") | there("pmid"), "needs_institutional_access").otherwise("no_identifier")
    route = F.when(first_ok, "europe_pmc_oa").when(second_ok, "unpaywall").when(first, "europe_pmc_oa").when(second, "unpaywall")
    own, other = F.col("route") == "europe_pmc_oa", F.col("route") == "unpaywall"
    r = r.withColumns({"category": category, "route": route})
    landing_url = F.when(own, F.concat(F.lit("https://europepmc.org/articles/"), "pmcid")).when(other, F.col("l_landing")).when(there("doi"), F.concat(F.lit("https://doi.org/"), "doi")).when(there("pmid"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")))
    note = F.when((F.col("category") == "needs_institutional_access") & there("doi"), "no lawful open location found").when(F.col("category") == "needs_institutional_access", "no DOI, and not open in the archive")
    return r.select("key", "title", "doi", "pmid", "pmcid", "category", "route", F.when(own, archive_url).when(other, F.col("l_url")).alias("url"), landing_url.alias("landing_url"), F.when(own, F.col("license")).when(other, F.col("l_license")).alias("used_license"), note.alias("note"))


def downloads(decided: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` decisions that a downloader may act on."""
    return decided.where((F.col("category") == "oa_machine_readable") & F.col("url").isNotNull()).orderBy("key").limit(most)


def document_errors(rows: DataFrame) -> DataFrame:
    """``key`` and ``error`` of downloaded documents (``key``, ``content_type``, ``body``) that are not what they claim: a PDF begins and ends as one does; an article in XML has its parts and a body of some length."""
    from ..sources.archive import media_type
    from .claims import article_text

    kind = media_type(F.col("content_type"))
    head, tail = F.decode(F.substring("body", 1, 5), "ISO-8859-1"), F.decode(F.expr("substring(body, greatest(octet_length(body) - 1023, 1), 1024)"), "ISO-8859-1")
    xml = kind.isin("application/xml", "text/xml") | kind.endswith("+xml")
    r = rows.withColumn("x", article_text(F.when(xml, F.col("body"))))
    text = F.regexp_extract(F.decode("body", "UTF-8"), r"(?is)<(?:\w+:)?body\b[^>]*>(.*)</(?:\w+:)?body>", 1)
    length = F.length(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " ")))
    pdf = F.when(head != "%PDF-", "not a PDF").when(~tail.contains("startxref"), "no cross-reference").when(~tail.contains("%%EOF"), "no end mark")
    article = F.when(F.col("x.error").isNotNull(), F.col("x.error")).when(length < 200, "body too short")
    error = F.when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "empty").when(kind == "application/pdf", pdf).when(xml, article).otherwise("content type")
    return r.select("key", error.alias("error")).where("error is not null")
