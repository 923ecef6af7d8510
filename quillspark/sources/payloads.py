"""Readers of archived source payloads. A payload that does not fit its schema becomes an issue row, not a missing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_xml_text, first_year, normalize_doi, short_work_id

EUROPE_PMC = "hitCount long, nextCursorMark string, resultList struct<result:array<struct<id:string,source:string,pmid:string,pmcid:string,doi:string,title:string,authorString:string,pubYear:string,isOpenAccess:string,abstractText:string,license:string>>>"
OPENALEX = "meta struct<count:long,next_cursor:string>, results array<struct<id:string,title:string,doi:string,ids:struct<pmid:string>,publication_year:int,open_access:struct<is_oa:boolean,oa_url:string>,abstract_inverted_index:map<string,array<int>>,referenced_works:array<string>>>"
CROSSREF = "message struct<`total-results`:long,items:array<struct<DOI:string,title:array<string>,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<family:string,given:string>>,abstract:string>>>"
PUBMED = "result map<string,string>"
_SUMMARY = "title string, articleids array<struct<idtype:string,value:string>>, authors array<struct<name:string>>, pubtype array<string>, pubdate string, source string"


def _parsed(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select("request_id", F.col("body"), F.from_json(F.col("body").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("p"))


def issues(payloads: DataFrame, source: str, schema: str, required: str) -> DataFrame:
    """Payloads without the required part."""
    return _parsed(payloads, schema).where(F.expr(required).isNull()).select("request_id", F.lit(source).alias("source"), F.lit("parse").alias("stage"), F.lit("unexpected payload").alias("message"), F.lit(False).alias("fatal"))


def _split(c: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")


def europe_pmc(payloads: DataFrame) -> DataFrame:
    rows = _parsed(payloads, EUROPE_PMC).select("request_id", F.posexplode("p.resultList.result").alias("pos", "r")).where("r.title is not null")
    return rows.select("request_id", "pos", F.col("r.title").alias("title"), normalize_doi(F.col("r.doi")).alias("doi"), F.col("r.pmid").alias("pmid"), F.col("r.pmcid").alias("pmcid"), _split(F.col("r.authorString"), ",").alias("authors"), first_year(F.col("r.pubYear")).alias("year"), F.when(F.col("r.isOpenAccess") == "Y", "open").when(F.col("r.isOpenAccess") == "N", "closed_or_not_open").otherwise("unknown").alias("access"))


def openalex(payloads: DataFrame) -> DataFrame:
    rows = _parsed(payloads, OPENALEX).select("request_id", F.posexplode("p.results").alias("pos", "r")).where("r.title is not null")
    return rows.select("request_id", "pos", F.col("r.title").alias("title"), normalize_doi(F.col("r.doi")).alias("doi"), F.nullif(F.regexp_extract(F.col("r.ids.pmid"), r"([0-9]+)/?$", 1), F.lit("")).alias("pmid"), short_work_id(F.col("r.id")).alias("work"), F.col("r.publication_year").alias("year"), F.transform("r.referenced_works", short_work_id).alias("references"), F.col("r.abstract_inverted_index").alias("abstract_index"))


def openalex_edges(works: DataFrame) -> DataFrame:
    return works.select(F.col("work").alias("src"), F.explode("references").alias("dst"))


def crossref(payloads: DataFrame) -> DataFrame:
    rows = _parsed(payloads, CROSSREF).select("request_id", F.posexplode("p.message.items").alias("pos", "r"))
    return rows.select("request_id", "pos", F.get("r.title", F.lit(0)).alias("title"), normalize_doi(F.col("r.DOI")).alias("doi"), F.get(F.get(F.col("r.issued.date-parts"), F.lit(0)), F.lit(0)).alias("year"), F.transform("r.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))).alias("authors")).where("title is not null")


def pubmed(payloads: DataFrame) -> DataFrame:
    rows = _parsed(payloads, PUBMED).select("request_id", F.explode("p.result").alias("pmid", "body")).where("pmid <> 'uids'")
    rows = rows.select("request_id", "pmid", F.from_json("body", _SUMMARY).alias("r")).where("r.title is not null")
    ids = F.map_from_entries(F.filter("r.articleids", lambda x: x["idtype"].isNotNull()))
    return rows.select("request_id", "pmid", F.col("r.title").alias("title"), normalize_doi(ids["doi"]).alias("doi"), ids["pmc"].alias("pmcid"), F.transform("r.authors", lambda a: a["name"]).alias("authors"), first_year(F.col("r.pubdate")).alias("year"), F.col("r.source").alias("journal"), F.exists("r.pubtype", lambda p: F.lower(p).contains("retract")).alias("flagged"))


#: Fixed value: the one document type that may be declared.
DOCTYPE = r'(?i)<!DOCTYPE\s+PubmedArticleSet\s+PUBLIC\s+"-//NLM//DTD PubMedArticle,\s*[^"<>]+//EN"\s+"https://dtd\.nlm\.nih\.gov/ncbi/pubmed/out/pubmed_[0-9]+\.dtd"\s*>'


def safe_xml(c: Column) -> Column:
    """The document without its declaration of the one known type; null if it declares entities, another type, or more than one."""
    declared = F.regexp_count(c, F.lit(r"(?i)<!DOCTYPE\b[^>]*>"))
    known = F.regexp_count(c, F.lit(DOCTYPE))
    return F.when(~F.upper(c).contains("<!ENTITY") & (declared <= 1) & (declared == known), F.regexp_replace(c, DOCTYPE, ""))


def relation_doi(relation: Column) -> Column:
    """The DOI of a notice: of its identifiers, its own, or the first one in its source or note."""
    ids = F.filter(relation["ArticleIdList"]["ArticleId"], lambda i: F.lower(i["_IdType"]) == "doi")
    listed = F.get(F.filter(F.transform(ids, lambda i: normalize_doi(clean_xml_text(i["_VALUE"]))), lambda d: d.isNotNull()), F.lit(0))
    inside = lambda c: normalize_doi(F.regexp_extract(c, "(?i)(10\\.[0-9]{4,9}/[^\\s<>\\]\\[\"']+)", 1))
    return F.coalesce(listed, normalize_doi(clean_xml_text(relation["DOI"])), inside(relation["RefSource"]), inside(relation["Note"]))


def pubmed_relations(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notices of the article that was asked for (``request_id``, ``pmid``, ``body``: a set of articles in XML) and issues: unsafe or broken XML, an error in it, or not exactly one article of that PMID."""
    notice = "struct<_RefType:string,PMID:string,DOI:string,RefSource:string,Note:string,ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
    schema = f"PubmedArticle array<struct<MedlineCitation:struct<PMID:string,CommentsCorrectionsList:struct<CommentsCorrections:array<{notice}>>>>>, ERROR string"
    safe = safe_xml(F.col("body").cast("string"))
    p = payloads.select("request_id", F.col("pmid").cast("string").alias("pmid"), safe.alias("safe"), F.from_xml(F.coalesce(safe, F.lit("<none/>")), schema).alias("p"))
    mine = F.filter("p.PubmedArticle", lambda a: clean_xml_text(a["MedlineCitation"]["PMID"]) == F.col("pmid"))
    broken = F.lower(F.col("safe")).rlike(r"<error\b")
    message = F.when(F.col("safe").isNull(), "unsafe declaration").when(broken, "explicit error").when(F.coalesce(F.size(mine), F.lit(0)) != 1, "not exactly one article")
    p = p.withColumns({"message": message, "one": F.get(mine, F.lit(0))})
    issues_ = p.where("message is not null").select("request_id", F.lit("pubmed").alias("source"), F.lit("relations").alias("stage"), "message", F.lit(False).alias("fatal"))
    rows = p.where("message is null").select("request_id", "pmid", F.explode("one.MedlineCitation.CommentsCorrectionsList.CommentsCorrections").alias("r")).where("r._RefType is not null and r._RefType <> ''")
    return rows.select("request_id", "pmid", F.col("r._RefType").alias("ref_type"), clean_xml_text(F.col("r.PMID")).alias("other_pmid"), relation_doi(F.col("r")).alias("doi"), clean_xml_text(F.col("r.Note")).alias("note")), issues_


def pagination_state(returned: Column, available: Column, cap: Column, failed: Column) -> Column:
    """A page run is partial if a page failed, truncated if the cap cut it, else complete."""
    return F.when(failed, "partial").when(returned >= available, "complete").when(returned >= cap, "truncated").otherwise("partial")
