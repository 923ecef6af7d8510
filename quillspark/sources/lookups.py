"""Lookups of single works, links and locations in archived answers. An answer is a row ``key``, ``status`` (of the response), ``body``; of a key the last by ``seq`` counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_doi, short_work_id
from .paging import europe_record, work_record

_EUROPE_CORE = "resultList struct<result:array<struct<id:string,source:string,pmid:string,pmcid:string,doi:string,title:string,authorString:string,journalTitle:string,pubYear:string,pubType:string,isOpenAccess:string,isRetracted:string,abstractText:string,license:string>>>"
_OPEN_WORK = "id string, title string, display_name string, doi string, ids struct<doi:string,pmid:string,pmcid:string>, publication_year int, type string, is_retracted boolean, primary_location struct<source:struct<display_name:string>>, open_access struct<is_oa:boolean,oa_url:string>, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"


def last_answers(answers: DataFrame) -> DataFrame:
    """The last answer of each key, with ``error``: none but a success is an answer, and nothing stands in for it."""
    one = answers.groupBy("key").agg(F.max_by(F.struct("status", "body"), "seq").alias("a")).select("key", "a.*")
    return one.withColumn("error", F.when(F.col("status").isNull() | ~F.col("status").between(200, 299), F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none")))).when(F.col("body").isNull(), "no body"))


def replay(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """``key``, ``text``, ``json`` (null unless an object) and ``error`` of the wanted keys; a key without an answer is an error."""
    a = wanted.select("key").distinct().join(last_answers(answers), "key", "left")
    text = F.when(F.col("error").isNull(), F.try_validate_utf8(F.col("body").cast("string")))
    parsed = F.try_parse_json(text)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    error = F.when(F.col("status").isNull() & F.col("body").isNull(), "not archived").otherwise(F.col("error"))
    return a.select("key", text.alias("text"), F.when(is_object, text).alias("json"), F.coalesce(error, F.when(~F.coalesce(is_object, F.lit(False)), "not a JSON object")).alias("error"))


def registry_works(answers: DataFrame) -> DataFrame:
    """Works of a registry by ``key`` (a doi): evidence fields, and what ``verify`` takes."""
    schema = "message struct<DOI:string,title:array<string>,type:string,subtype:string,`update-to`:array<struct<type:string,label:string>>,relation:map<string,array<struct<type:string,label:string>>>,reference:array<struct<DOI:string>>>"
    a = last_answers(answers).where("error is null").select(normalize_doi(F.col("key")).alias("key"), F.from_json(F.col("body").cast("string"), schema)["message"].alias("m")).where("m is not null and key is not null")
    doi = normalize_doi(F.col("m.DOI"))
    return a.select("key", F.col("m.DOI").alias("doi"), F.nullif(F.trim(F.get("m.title", F.lit(0))), F.lit("")).alias("title"), F.col("m.type").alias("type"), F.col("m.subtype").alias("subtype"), F.col("m.update-to").alias("updates"), F.col("m.relation").alias("relation"), doi.alias("record_id"), F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.lit("https://www.crossref.org/")).alias("url"), F.col("m.reference").alias("references"))


def reference_dois(works: DataFrame) -> DataFrame:
    """``key``, the distinct DOIs of its deposited references in order, and how many references there are, with or without one."""
    dois = F.filter(F.transform("references", lambda r: normalize_doi(r["DOI"])), lambda d: d.isNotNull())
    return works.select("key", F.coalesce(F.array_distinct(dois), F.array().cast("array<string>")).alias("dois"), F.coalesce(F.when(F.col("references").isNotNull(), F.size("references")), F.lit(0)).cast("long").alias("deposited"))


def update_notices(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notices that update a doi (``target``, ``type``, ``label``), and lookups (``key``, ``failure``): one that is cut, or holds an item that is not bound to its target, fails as a whole."""
    schema = "message struct<`total-results`:string,items:array<struct<`update-to`:array<struct<DOI:string,type:string,label:string>>>>>"
    a = last_answers(answers).select(normalize_doi(F.col("key")).alias("target"), "error", F.from_json(F.col("body").cast("string"), schema)["message"].alias("m"))
    items = F.col("m.items")
    total = F.coalesce(F.col("m.total-results").try_cast("long"), F.when(F.col("m.total-results").isNull(), F.size(items)))
    mine = F.transform(items, lambda i: F.filter(i["update-to"], lambda u: normalize_doi(u["DOI"]).eqNullSafe(F.col("target"))))
    loose = F.exists(mine, lambda u: F.coalesce(F.size(u), F.lit(-1)) <= 0)
    failure = F.when(F.col("target").isNull(), "invalid doi").when(F.col("error").isNotNull(), F.col("error")).when(items.isNull(), "items missing").when(total.isNull(), "total invalid").when(total > F.size(items), "truncated").when(loose, "item not bound")
    a = a.withColumns({"failure": failure, "mine": F.flatten(mine)})
    return a.where("failure is null").select("target", F.explode("mine").alias("u")).select("target", "u.type", "u.label"), a.select(F.col("target").alias("key"), "failure")


def resolve_works(identifiers: DataFrame, works: DataFrame) -> DataFrame:
    """Works (``record_id``, ``doi``, ``pmid``, ...) of ``identifier``: a work's own id, a DOI or a PMID, in this order; ``error`` where it is none of them or leads nowhere."""
    short, doi = F.nullif(short_work_id(F.col("identifier")), F.lit("")), normalize_doi(F.col("identifier"))
    pmid = F.nullif(F.regexp_extract(F.trim("identifier"), r"(?i)^(?:pmid:)?([0-9]+)$", 1), F.lit(""))
    key = F.when(short.isNotNull() & doi.isNull(), F.concat(F.lit("w:"), short)).when(doi.isNotNull(), F.concat(F.lit("d:"), doi)).when(pmid.isNotNull(), F.concat(F.lit("p:"), pmid))
    keys = works.select("*", F.explode(F.array_compact(F.array(F.concat(F.lit("w:"), "record_id"), F.concat(F.lit("d:"), "doi"), F.concat(F.lit("p:"), "pmid")))).alias("k"))
    first = keys.groupBy("k").agg(F.min(F.struct("record_id", "doi", "pmid", "title")).alias("w"))
    out = identifiers.withColumn("k", key).join(first, "k", "left")
    return out.select("identifier", "w.*", F.when(F.col("k").isNull(), "unsupported identifier").when(F.col("w").isNull(), "not found").alias("error"))


def graph_works(answers: DataFrame) -> DataFrame:
    """Works of a graph source, one an answer."""
    parsed = F.from_json(F.col("body").cast("string"), _OPEN_WORK)
    return last_answers(answers).where("error is null").select("key", work_record(parsed).alias("r")).select("key", "r.*").where("title is not null")


def work_edges(works: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``pos``: references of works."""
    return works.where("record_id is not null").select(F.col("record_id").alias("src"), F.posexplode("references").alias("pos", "dst")).select("src", "dst", "pos")


def link_pages(pages: DataFrame, kind: str) -> DataFrame:
    """Links ``src`` (a PMID), ``pos``, ``dst`` (null where the other end has no PMID) and ``total`` from pages ``key``, ``page``, ``body`` of references or citations."""
    if kind not in ("references", "citations"):
        raise ValueError("kind must be references or citations")
    box = "referenceList struct<reference:array<struct<source:string,id:string>>>" if kind == "references" else "citationList struct<citation:array<struct<source:string,id:string>>>"
    p = pages.select("key", "page", F.from_json(F.col("body").cast("string"), f"hitCount long, {box}").alias("p"))
    items = F.col("p.referenceList.reference") if kind == "references" else F.col("p.citationList.citation")
    p = p.select("key", "page", F.col("p.hitCount").alias("hits"), F.posexplode(items).alias("i", "x"))
    total = F.max_by("hits", "page").over(Window.partitionBy("key"))
    dst = F.when((F.col("x.source") == "MED") & (F.col("x.id") != ""), F.col("x.id"))
    return p.select(F.col("key").alias("src"), F.row_number().over(Window.partitionBy("key").orderBy("page", "i")).alias("pos"), dst.alias("dst"), F.coalesce(total, F.lit(0)).alias("total"))


def neighbours(links: DataFrame, limit: int) -> DataFrame:
    """``src``, its distinct neighbours in order (``dsts``), the ``total`` reported, how many links have no PMID (``without``), and whether the limit cut them."""
    kept = links.where(F.col("pos") <= limit)
    rows = F.array_sort(F.collect_list(F.when(F.col("dst").isNotNull(), F.struct("pos", "dst"))))
    return kept.groupBy("src").agg(F.array_distinct(F.transform(rows, lambda x: x["dst"])).alias("dsts"), F.max("total").alias("total"), F.count_if(F.col("dst").isNull()).alias("without")).withColumn("truncated", F.col("total") > limit)


def core_records(pmids: DataFrame, answers: DataFrame) -> DataFrame:
    """Full records of the wanted ``pmid`` (digits only, each once) from batch answers, the last of each PMID, with abstracts and licences; those not among them have none."""
    wanted = pmids.select(F.col("pmid").cast("string").alias("pmid")).where(F.col("pmid").rlike("^[0-9]+$")).distinct()
    a = last_answers(answers).where("error is null").select("key", F.explode(F.from_json(F.col("body").cast("string"), _EUROPE_CORE)["resultList"]["result"]).alias("x")).select("key", europe_record(F.col("x")).alias("r")).select("key", "r.*").where("title is not null")
    return a.join(wanted, "pmid", "left_semi").groupBy("pmid").agg(F.max_by(F.struct(*(c for c in a.columns if c != "pmid")), "key").alias("r")).select("pmid", "r.*").drop("key")


def enrich(records: DataFrame, core: DataFrame) -> DataFrame:
    """Records with what the core record of their PMID adds: a PMCID and a DOI where they lack one, open access, an abstract and a licence."""
    c = core.select(F.col("pmid").alias("c_pmid"), F.col("pmcid").alias("c_pmcid"), F.col("doi").alias("c_doi"), F.col("access").alias("c_access"), F.col("abstract").alias("c_abstract"), F.col("license").alias("c_license"))
    full = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), b)
    r = records.join(c, F.col("pmid") == F.col("c_pmid"), "left")
    return r.withColumns({"pmcid": full("pmcid", "c_pmcid"), "doi": full("doi", "c_doi"), "access": F.when(F.col("c_access") == "open", "open").otherwise(F.col("access")), "abstract": F.coalesce("c_abstract", "abstract"), "license": F.coalesce("c_license", "license")}).drop("c_pmid", "c_pmcid", "c_doi", "c_access", "c_abstract", "c_license")


def first_store(stores: list[DataFrame]) -> DataFrame:
    """``key``, ``value`` of several stores; of a key the first store's counts."""
    ranked = [s.select("key", "value", F.lit(i).alias("rank")) for i, s in enumerate(stores)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    return every.where("value is not null").groupBy("key").agg(F.min(F.struct("rank", "value")).alias("v")).select("key", "v.value")


def open_locations(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best open locations by ``doi``, and issues; that a doi is not known there is no issue."""
    schema = "best_oa_location struct<url_for_pdf:string,url:string,url_for_landing_page:string,license:string,version:string>"
    a = last_answers(answers).withColumn("l", F.from_json(F.col("body").cast("string"), schema)["best_oa_location"])
    url = F.coalesce(F.nullif(F.col("l.url_for_pdf"), F.lit("")), F.nullif(F.col("l.url"), F.lit("")))
    found = a.where("error is null").select(F.col("key").alias("doi"), url.alias("url"), F.col("l.url_for_landing_page").alias("landing_url"), F.col("l.license").alias("license"), F.col("l.version").alias("version")).where("url is not null")
    issues = a.where("error is not null and coalesce(status, 0) <> 404").select(F.col("key").alias("doi"), F.lit("open_locations").alias("source"), F.col("error").alias("message"))
    return found, issues


