"""Licence candidates from public metadata. A candidate is what the metadata say, not a permission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json
from ..functions.policy import candidate_version

#: Where each kind of metadata may hold files, and single addresses.
FILES = ("$.full_text", "$.fullTextUrl", "$.files", "$.links")
ADDRESSES = ("$.pdf_url", "$.xml_url", "$.full_text_url", "$.href")
_LIST = "array<variant>"


def _text(v: Column, path: str) -> Column:
    """A text, trimmed, that is there and a string."""
    raw = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(raw)
    return F.when(kind == "STRING", F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit("")))


def _first(v: Column, *paths: str) -> Column:
    return F.coalesce(*(_text(v, p) for p in paths))


def _entries(v: Column, path: str) -> Column:
    """The objects at a path: one, or those of a list."""
    at = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(at)
    many = F.filter(F.coalesce(F.try_variant_get(v, path, _LIST), F.array().cast(_LIST)), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.when(kind.startswith("OBJECT"), F.array(at)).when(kind.startswith("ARRAY"), many).otherwise(F.array().cast(_LIST))


def _licence(v: Column, path: str) -> Column:
    """A licence as a text, an object with an address or text, or the first of a list that gives one."""
    inside = lambda x: F.coalesce(_text(x, "$"), _first(x, "$.URL", "$.url", "$.text"))
    many = F.filter(F.transform(F.coalesce(F.try_variant_get(v, path, _LIST), F.array().cast(_LIST)), inside), lambda t: t.isNotNull())
    return F.coalesce(_text(v, path), _first(v, f"{path}.URL", f"{path}.url", f"{path}.text"), F.get(many, F.lit(0)))


def _fragment(**parts: Column) -> Column:
    """The part of the metadata that a candidate comes from, as canonical JSON; members that are absent are null."""
    one = lambda c: F.coalesce(c, F.lit("null"))
    members = [F.concat(F.lit(f'"{k}":'), one(c)) for k, c in parts.items()]
    return canonical_json(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))


def _json(c: Column) -> Column:
    return F.to_json(c)


def _quoted(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"')))


def _candidates(rows: DataFrame, source: str) -> DataFrame:
    """Rows of ``rec``, ``record``, ``url``, ``licence``, ``raw_version`` and ``fragment``."""
    return rows.where("url is not null").select("rec", F.lit(source).alias("source"), "url", F.col("licence").alias("license_text"), candidate_version(F.col("raw_version")).alias("version"), "raw_version", F.col("record").alias("source_record"), F.col("fragment").alias("raw_fragment_json"))


def discover(metadata: DataFrame) -> DataFrame:
    """Candidates of each record, in their order (``position``), from ``rec``, ``kind`` (europe_pmc, pmc or crossref) and ``body`` (JSON).

    A file has its own licence and version, else the record's. A registry's link has the licences of its version, and only unscoped ones if it has none;
    without one it is a candidate of unknown licence. Of equal source, address, licence and version the first stays."""
    v = F.col("v")
    rows = metadata.select("rec", "kind", F.try_parse_json("body").alias("v")).where("v is not null")

    def files(kind: str, lists: Column, version: tuple[str, ...], licence: Column) -> DataFrame:
        record = _first(v, "$.pmcid", "$.id")
        each = rows.where(F.col("kind") == kind).select("rec", record.alias("record"), licence.alias("own"), _first(v, *version).alias("own_version"), _json(F.try_variant_get(v, "$.license", "variant")).alias("raw"), F.posexplode(lists).alias("pos", "e"))
        e = F.col("e")
        return each.select("rec", "pos", "record", _first(e, "$.url", "$.href").alias("url"), F.coalesce(_licence(e, "$.license"), "own").alias("licence"), F.coalesce(_first(e, *version), "own_version").alias("raw_version"), _fragment(record=_quoted(F.col("record")), full_text=_json(e), license=F.col("raw")).alias("fragment"))

    listed = _entries(v, "$.fullTextUrlList.fullTextUrl")
    europe = files("europe_pmc", F.when(F.size(listed) > 0, listed).otherwise(_entries(v, "$.fullTextUrl")), ("$.version", "$.manuscriptVersion"), _licence(v, "$.license"))
    alone = F.array_compact(F.array(*(F.when(_text(v, p).isNotNull(), F.try_parse_json(F.concat(F.lit('{"url":'), _quoted(_text(v, p)), F.lit("}")))) for p in ADDRESSES)))
    pmc = files("pmc", F.concat(*(_entries(v, p) for p in FILES), alone), ("$.version", "$.manuscript_version"), F.coalesce(_licence(v, "$.license"), _licence(v, "$.license_url"), _licence(v, "$.license_text")))

    crossref = rows.where("kind = 'crossref'").select("rec", _first(v, "$.DOI", "$.doi").alias("record"), _entries(v, "$.license").alias("licences"), F.posexplode(_entries(v, "$.link")).alias("pos", "e"))
    e = F.col("e")
    crossref = crossref.withColumn("own_version", _first(e, "$['content-version']", "$.version"))
    same = F.filter("licences", lambda x: _text(x, "$['content-version']").eqNullSafe(F.col("own_version")))
    crossref = crossref.withColumn("l", F.explode_outer(same))
    lic = F.col("l")
    crossref = crossref.select("rec", "pos", "record", _first(e, "$.URL", "$.url").alias("url"), F.when(lic.isNotNull(), F.coalesce(_licence(lic, "$.URL"), _licence(lic, "$.url"), _licence(lic, "$.license"))).alias("licence"), F.coalesce("own_version", _text(lic, "$['content-version']")).alias("raw_version"), _fragment(record=_quoted(F.col("record")), link=_json(e), license=F.when(lic.isNotNull(), _json(lic))).alias("fragment"))

    every = _candidates(europe, "europe_pmc").unionByName(_candidates(pmc, "pmc")).unionByName(_candidates(crossref, "crossref"))
    key = ["rec", "source", "url", "license_text", "version"]
    one = every.groupBy(*key).agg(F.min(F.struct("raw_fragment_json", "raw_version", "source_record")).alias("f")).select(*key, "f.raw_version", "f.source_record", "f.raw_fragment_json")
    sorted_ = F.array_sort(F.collect_list(F.struct("source", "url", F.coalesce("license_text", F.lit("")).alias("a"), F.coalesce("version", F.lit("")).alias("b"), "license_text", "version", "raw_version", "source_record", "raw_fragment_json")))
    out = one.groupBy("rec").agg(sorted_.alias("cs")).select("rec", F.posexplode("cs").alias("p", "c"))
    return out.select("rec", (F.col("p") + 1).cast("long").alias("position"), *(F.col(f"c.{c}").alias(c) for c in ("source", "url", "license_text", "version", "raw_version", "source_record", "raw_fragment_json")))
