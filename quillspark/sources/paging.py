"""Search runs over archived pages: what a source's paging yields, up to its cap, and whether that is all.

A page is a row ``run``, ``page`` (from 0), ``cursor`` (that it was asked with), ``body`` (bytes or text). Pages count in order until the run stops:
when its target is reached, on an empty page, when the cursor does not move, or when a page is of no use; what was read is kept, and the reason becomes an
error of the run. A payload without its required part ends the run as partial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_year, normalize_doi, short_work_id, strip_tags
from ..functions.validate import paging

_EUROPE = "hitCount string, nextCursorMark string, resultList struct<result:array<struct<id:string,source:string,pmid:string,pmcid:string,doi:string,title:string,authorString:string,journalTitle:string,pubYear:string,pubType:string,isOpenAccess:string,isRetracted:string,abstractText:string,license:string>>>"
_OPEN = "meta struct<count:string,next_cursor:string>, results array<struct<id:string,title:string,display_name:string,doi:string,ids:struct<doi:string,pmid:string,pmcid:string>,publication_year:int,type:string,is_retracted:boolean,primary_location:struct<source:struct<display_name:string>>,open_access:struct<is_oa:boolean,oa_url:string>,authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>,referenced_works:array<string>>>"
_CROSS = "message struct<`total-results`:string,items:array<struct<DOI:string,title:array<string>,`container-title`:array<string>,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<family:string,given:string>>,type:string,abstract:string>>>"
_SUMMARY = "title string, articleids array<struct<idtype:string,value:string>>, authors array<struct<name:string>>, pubtype array<string>, pubdate string, source string, fulljournalname string, recordstatus string"
#: How far ranked results may be paged, and the largest page of each source.
RANKED_MOST = 10_000
PAGE_MOST = {"openalex": 200, "crossref": 1000}


def request_size(source: str, limit: int | None, page_size: int) -> int:
    """The page size a source is asked for; raises on arguments that it does not take."""
    return min(paging(limit, page_size, RANKED_MOST if source == "crossref" else None), PAGE_MOST.get(source, page_size))


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _list(c: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")


def _flag(c: Column) -> Column:
    return F.when(c == "Y", "flagged").when(c == "N", "not_flagged").otherwise("unknown")


def record(source: str, title: Column, **more: Column) -> Column:
    """A record in the shape that merging takes."""
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    get = lambda k, default=null: more.get(k, default)
    return F.struct(
        F.lit(source).alias("source"), _blank(title).alias("title"), get("authors", none).alias("authors"), get("journal").alias("journal"), get("year", F.lit(None).cast("int")).alias("year"), normalize_doi(get("doi")).alias("doi"),
        get("pmid").alias("pmid"), get("pmcid").alias("pmcid"), get("types", none).alias("types"), get("access", F.lit("unknown")).alias("access"), get("access_url").alias("access_url"), get("flag", F.lit("unknown")).alias("flag"),
        get("record_id").alias("record_id"), get("url").alias("url"), get("abstract").alias("abstract"), get("license").alias("license"), get("references", none).alias("references"),
    )


def europe_record(r: Column) -> Column:
    opened = F.upper(F.coalesce(r["isOpenAccess"], F.lit("")))
    url = F.when(_blank(r["pmcid"]).isNotNull(), F.concat(F.lit("https://europepmc.org/articles/"), r["pmcid"])).otherwise(F.concat(F.lit("https://europepmc.org/article/"), F.coalesce(r["source"], F.lit("MED")), F.lit("/"), F.coalesce(r["id"], F.lit(""))))
    return record(
        "europe_pmc", r["title"], authors=_list(F.rtrim(r["authorString"], F.lit(".")), ","), journal=r["journalTitle"], year=first_year(r["pubYear"]), doi=r["doi"], pmid=_blank(r["pmid"]), pmcid=_blank(r["pmcid"]), types=_list(r["pubType"], ";"),
        access=F.when(opened == "Y", "open").when(opened == "N", "closed_or_not_open").otherwise("unknown"), access_url=url, flag=_flag(F.upper(r["isRetracted"])), record_id=r["id"], url=url, abstract=_blank(F.regexp_replace(r["abstractText"], r"\s+", " ")), license=_blank(r["license"]),
    )


def work_record(r: Column) -> Column:
    short = short_work_id(r["id"])
    is_open = r["open_access"]["is_oa"]
    # the last word of a place stays
    pairs = F.flatten(F.transform(F.map_entries(r["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    abstract = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
    return record(
        "openalex", F.coalesce(_blank(r["title"]), r["display_name"]), authors=F.array_compact(F.transform(r["authorships"], lambda a: _blank(a["author"]["display_name"]))), journal=r["primary_location"]["source"]["display_name"], year=r["publication_year"],
        doi=F.coalesce(r["doi"], r["ids"]["doi"]), pmid=F.nullif(F.regexp_extract(r["ids"]["pmid"], r"([0-9]+)$", 1), F.lit("")), pmcid=F.nullif(F.upper(F.regexp_extract(r["ids"]["pmcid"], r"(?i)(PMC[0-9]+)", 1)), F.lit("")), types=F.array_compact(F.array(r["type"])),
        access=F.when(is_open, "open").when(~is_open, "closed_or_not_open").otherwise("unknown"), access_url=F.when(is_open, r["open_access"]["oa_url"]), flag=F.when(r["is_retracted"], "flagged").when(~r["is_retracted"], "not_flagged").otherwise("unknown"),
        record_id=F.nullif(short, F.lit("")), url=F.concat(F.lit("https://openalex.org/"), short), abstract=abstract, references=F.filter(F.transform(r["referenced_works"], short_work_id), lambda x: x != ""),
    )


def ranked_record(r: Column) -> Column:
    names = F.filter(F.transform(r["author"], lambda a: F.concat_ws(" ", a["family"], a["given"])), lambda x: x != "")
    doi = normalize_doi(r["DOI"])
    return record(
        "crossref", F.get(r["title"], F.lit(0)), authors=names, journal=F.get(r["container-title"], F.lit(0)), year=F.get(F.get(r["issued"]["date-parts"], F.lit(0)), F.lit(0)), doi=r["DOI"], types=F.array_compact(F.array(r["type"])), record_id=doi,
        url=F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.lit("https://www.crossref.org/")), abstract=_blank(strip_tags(r["abstract"])),
    )


def _walk(pages: DataFrame, cap: int | None, stuck: bool) -> tuple[DataFrame, DataFrame]:
    """Records up to the cap, and the run's state, of pages ``run``, ``page``, ``cursor``, ``next``, ``total``, ``bad`` (why the payload cannot be used), ``records``, ``n_items``."""
    w = Window.partitionBy("run").orderBy("page")
    usable = F.filter("records", lambda r: r["title"].isNotNull())
    p = pages.withColumns({"good": usable, "all_total": F.first("total", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    p = p.withColumn("upto", F.sum(F.size("good")).over(w))
    target = F.coalesce("all_total", F.lit(0)) if cap is None else F.least(F.coalesce("all_total", F.lit(0)), F.lit(cap))
    reached = F.col("upto") >= target
    why = F.when(F.col("bad").isNotNull(), F.col("bad")).when(reached, "").when(F.col("n_items") == 0, "empty_page")
    if stuck:
        why = why.when(F.col("next").isNull() | (F.col("next") == F.col("cursor")), "cursor_stuck")
    why = why.when(F.size("good") == 0, "no_usable_record")
    p = p.withColumn("stop", why)
    p = p.withColumn("stopped", F.coalesce(F.max(F.col("stop").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("stopped = 0")
    records = p.select("run", "page", F.posexplode("good").alias("pos", "r"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("page", "pos"))
    records = records.withColumn("position", place.cast("long"))
    if cap is not None:
        records = records.where(F.col("position") <= cap)
    lost = F.size("records") - F.size("good")
    last = F.max_by(F.struct("stop", "all_total", "upto"), "page")
    run = p.groupBy("run").agg(last.alias("l"), F.count("*").alias("pages"), F.sum(lost).alias("unusable"))
    returned = F.col("l.upto") if cap is None else F.least("l.upto", F.lit(cap))
    total = F.coalesce("l.all_total", F.lit(0)).cast("long")
    errors = F.array_compact(F.array(F.when(F.coalesce("l.stop", F.lit("pages_missing")) != "", F.coalesce("l.stop", F.lit("pages_missing"))), F.when(F.col("unusable") > 0, "unusable_records")))
    state = F.when(F.size(errors) > 0, "partial").when(F.lit(cap is not None) & (total > F.lit(cap or 0)), "truncated").otherwise("complete")
    return records.select("run", "position", "r.*"), run.select("run", state.alias("state"), total.alias("total_available"), returned.cast("long").alias("records_returned"), "pages", errors.alias("errors"))


def _number(c: Column) -> Column:
    return c.try_cast("long")


def europe_pmc(pages: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and states of cursor searches."""
    p = pages.withColumn("p", F.from_json(F.col("body").cast("string"), _EUROPE))
    total = _number(F.coalesce("p.hitCount", F.lit("0")))
    bad = F.when(F.col("p.resultList").isNull(), "result_list_missing").when(total.isNull(), "total_invalid").when(F.col("p.resultList.result").isNull(), "results_missing")
    items = F.coalesce("p.resultList.result", F.array())
    return _walk(p.select("run", "page", F.coalesce("cursor", F.lit("*")).alias("cursor"), F.col("p.nextCursorMark").alias("next"), total.alias("total"), bad.alias("bad"), F.transform(items, europe_record).alias("records"), F.size(items).alias("n_items")), limit, True)


def openalex(pages: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and states of cursor searches; abstracts and references come with the records. A record without a title is no error here, as the source has them."""
    p = pages.withColumn("p", F.from_json(F.col("body").cast("string"), _OPEN))
    total = _number(F.coalesce("p.meta.count", F.lit("0")))
    bad = F.when(total.isNull(), "total_invalid").when(F.col("p.results").isNull(), "results_missing")
    records = F.filter(F.transform(F.coalesce("p.results", F.array()), work_record), lambda r: r["title"].isNotNull())
    return _walk(p.select("run", "page", F.coalesce("cursor", F.lit("*")).alias("cursor"), F.col("p.meta.next_cursor").alias("next"), total.alias("total"), bad.alias("bad"), records.alias("records"), F.size(F.coalesce("p.results", F.array())).alias("n_items")), limit, True)


def crossref(pages: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Records and states of ranked searches by offset, which demand a limit; one that stops at the largest offset is partial."""
    paging(limit, 1, RANKED_MOST)
    p = pages.withColumn("p", F.from_json(F.col("body").cast("string"), _CROSS))
    items = F.coalesce("p.message.items", F.array())
    before = F.sum(F.size(items)).over(Window.partitionBy("run").orderBy("page"))
    bad = F.when(F.col("p.message.items").isNull(), "items_missing")
    records = F.filter(F.transform(items, ranked_record), lambda r: r["title"].isNotNull())
    total = _number(F.coalesce("p.message.total-results", F.lit("0")))
    rows, run = _walk(p.select("run", "page", F.lit("*").alias("cursor"), F.lit(None).cast("string").alias("next"), total.alias("total"), bad.alias("bad"), records.alias("records"), F.size(items).alias("n_items"), before.alias("offset")), limit, False)
    return rows, run


def pubmed(sets: DataFrame, pages: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and states of searches whose set of identifiers a server fixed: ``sets`` (``run``, ``body``) has its size and handle, without which there is no run but an error; ``pages`` are its summaries by offset, which do not depend on each other."""
    s = sets.select("run", F.from_json(F.col("body").cast("string"), "esearchresult struct<count:string,querykey:string,webenv:string>").alias("e"))
    total = _number(F.coalesce("e.esearchresult.count", F.lit("0")))
    refused = F.when(F.col("e.esearchresult").isNull(), "search_result_missing").when(total.isNull(), "total_invalid").when(_blank(F.col("e.esearchresult.querykey")).isNull(), "query_key_missing").when(_blank(F.col("e.esearchresult.webenv")).isNull(), "history_missing")
    s = s.select("run", total.alias("total"), refused.alias("refused"))
    p = pages.join(s, "run").withColumns({"m": F.from_json(F.col("body").cast("string"), "result map<string,string>"), "total": F.coalesce("total", F.lit(0))})
    uids = F.from_json(F.col("m.result")["uids"], "array<string>")
    one = lambda u: F.struct(u.alias("uid"), F.from_json(F.col("m.result")[u], _SUMMARY).alias("r"))

    def summary(x: Column) -> Column:
        r, u = x["r"], x["uid"]
        ids = F.filter(r["articleids"], lambda a: a["idtype"] == "doi")
        return record(
            "pubmed", r["title"], authors=F.array_compact(F.transform(r["authors"], lambda a: _blank(a["name"]))), journal=F.coalesce(_blank(r["fulljournalname"]), r["source"]), year=first_year(r["pubdate"]), doi=F.get(F.transform(ids, lambda a: a["value"]), F.size(ids) - 1), pmid=u,
            types=F.coalesce(r["pubtype"], F.array().cast("array<string>")), flag=F.when(F.exists(r["pubtype"], lambda t: F.lower(t).contains("retracted publication")), "flagged").otherwise("unknown"), record_id=u, url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), u, F.lit("/")),
        )

    found = F.transform(F.transform(F.coalesce(uids, F.array().cast("array<string>")), one), summary)
    bad = F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("m.result").isNull(), "result_missing").when(uids.isNull(), "uids_missing")
    rows, run = _walk(p.select("run", "page", F.lit("*").alias("cursor"), F.lit(None).cast("string").alias("next"), "total", bad.alias("bad"), found.alias("records"), F.size(F.coalesce(uids, F.array().cast("array<string>"))).alias("n_items")), limit, False)
    alone = s.where("refused is not null").join(run.select("run"), "run", "left_anti").select("run", F.lit("partial").alias("state"), F.coalesce("total", F.lit(0)).cast("long").alias("total_available"), F.lit(0).cast("long").alias("records_returned"), F.lit(0).cast("long").alias("pages"), F.array("refused").alias("errors"))
    nothing = s.where("refused is null and total = 0").join(run.select("run"), "run", "left_anti").select("run", F.lit("complete").alias("state"), F.lit(0).cast("long").alias("total_available"), F.lit(0).cast("long").alias("records_returned"), F.lit(0).cast("long").alias("pages"), F.array().cast("array<string>").alias("errors"))
    return rows, run.unionByName(alone).unionByName(nothing)


#: Sources by name; each takes its pages and a limit.
SOURCES = {"europe_pmc": europe_pmc, "openalex": openalex, "crossref": crossref}


def search(source: str, pages: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and states of one source's runs; pubmed also needs its sets and is called by itself."""
    if source not in SOURCES:
        raise ValueError(f"no such source: {source}")
    return SOURCES[source](pages, limit)
