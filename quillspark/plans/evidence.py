"""Named queries of the operators on sources, verification, access and audits, with SQL that gives the same rows where SQL can.

No driver table holds such records, so each query makes its input from one: the operator is as it would be on real records, and the
SQL computes the operator's result from the same columns by its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy, validate
from ..functions.hashing import canonical_json
from ..operators import access, claims, crossmark, licences, official, pdfrefs, release, reports, store, verify
from ..sources import lookups, paging
from ..streaming import batch
from . import snowball
from .catalogue import RULE, query
from .tables import read, saved


def _null():
    return F.lit(None).cast("string")


def _json(*fields, **more):
    return F.to_json(F.struct(*fields, *(c.alias(k) for k, c in more.items())))


# --- sources ---------------------------------------------------------------------------------------------------------------


def _epmc_pages(spark, sf):
    """Orders of a customer as the hits of a search, three a page; a page's cursor leads on, save in some runs, and some hits have no title."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("k"), "o_orderpriority")
    rows = F.array_sort(F.collect_list(F.struct("k", F.when(F.col("k") % 17 > 0, F.col("o_orderpriority")).alias("title"))))
    hits = o.groupBy("run").agg(rows.alias("hs"), F.count("*").alias("n"))
    pages = hits.select("run", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(3)), lambda i: F.slice("hs", i + 1, 3))).alias("page", "items"))
    item = F.transform("items", lambda x: F.struct(x["k"].cast("string").alias("id"), x["title"].alias("title"), x["k"].cast("string").alias("pmid")))
    mark = F.when((F.col("run") % 13 == 0) & (F.col("page") == 1), F.lit("c1")).otherwise(F.concat(F.lit("c"), F.col("page") + 1))
    body = F.to_json(F.struct(F.col("n").alias("hitCount"), mark.alias("nextCursorMark"), F.struct(item.alias("result")).alias("resultList")))
    lost = (F.col("run") % 11 == 0) & (F.col("page") == 2)
    return pages.select(F.col("run").cast("string").alias("run"), "page", F.when(F.col("page") == 0, "*").otherwise(F.concat(F.lit("c"), "page")).alias("cursor"), F.when(lost, F.lit('{"hitCount": 1}')).otherwise(body).alias("body"))


_HITS = """h AS (SELECT o_custkey AS c, o_orderkey AS k, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS page, count(*) OVER (PARTITION BY o_custkey) AS n, (o_orderkey % 17 > 0)::INT AS ok FROM orders),
g AS (SELECT c, page, max(n) AS n, sum(ok) AS good, count(*) AS items FROM h GROUP BY c, page),
w AS (SELECT *, (c % 11 = 0 AND page = 2) AS lost FROM g),
u AS (SELECT *, sum(CASE WHEN lost THEN 0 ELSE good END) OVER (PARTITION BY c ORDER BY page) AS upto FROM w),
s AS (SELECT *, CASE WHEN lost THEN 'result_list_missing' WHEN upto >= least(n, 8) THEN '' WHEN c % 13 = 0 AND page = 1 THEN 'cursor_stuck' WHEN good = 0 THEN 'no_usable_record' END AS stop FROM u),
first_stop AS (SELECT c, min(page) FILTER (stop IS NOT NULL) AS at FROM s GROUP BY c),
k AS (SELECT s.* FROM s JOIN first_stop f ON f.c = s.c AND (f.at IS NULL OR s.page <= f.at)),
r AS (SELECT c, max(n) AS n, arg_max(upto, page) AS upto, arg_max(coalesce(stop, 'pages_missing'), page) AS stop, count(*) AS pages, sum(CASE WHEN lost THEN 0 ELSE items - good END) AS odd FROM k GROUP BY c)"""


@query(f"""WITH {_HITS} SELECT c::VARCHAR AS run, CASE WHEN stop <> '' OR odd > 0 THEN 'partial' WHEN n > 8 THEN 'truncated' ELSE 'complete' END AS state, n AS total_available, least(upto, 8)::BIGINT AS records_returned, pages,
array_to_string(list_filter([CASE WHEN stop <> '' THEN stop END, CASE WHEN odd > 0 THEN 'unusable_records' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def q_search_states(spark, sf):
    return paging.europe_pmc(_epmc_pages(spark, sf), 8)[1].withColumn("errors", F.array_join("errors", ","))


@query(f"""WITH {_HITS}, t AS (SELECT h.c, h.k, row_number() OVER (PARTITION BY h.c ORDER BY h.k) AS position FROM h JOIN k ON k.c = h.c AND k.page = h.page WHERE ok = 1 AND NOT lost)
SELECT c::VARCHAR AS run, position, k::VARCHAR AS pmid, 'https://europepmc.org/article/MED/' || k AS url FROM t WHERE position <= 8""")
def q_search_records(spark, sf):
    return paging.europe_pmc(_epmc_pages(spark, sf), 8)[0].select("run", "position", "pmid", "url")


def _works(spark, sf):
    """Parts as works of a graph source; a part refers to the next ones of its size."""
    p = read(spark, sf, "part")
    k = F.col("p_partkey")
    body = F.to_json(F.struct(F.concat(F.lit("https://openalex.org/W"), k).alias("id"), F.when(k % 9 > 0, F.col("p_name")).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/P"), k)).alias("doi"), F.struct(F.when(k % 3 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), k)).alias("pmid")).alias("ids"), (F.col("p_size") + 1990).alias("publication_year"), (k % 10 == 0).alias("is_retracted"), F.transform(F.sequence(F.lit(1), F.col("p_size") % 3 + 1), lambda i: F.concat(F.lit("https://openalex.org/W"), (k + i).cast("string"))).alias("referenced_works")))
    return p.select(F.concat(F.lit("W"), k).alias("key"), F.lit(1).alias("seq"), F.when(k % 7 == 0, 404).otherwise(200).alias("status"), body.alias("body"))


_WORKS = "w AS (SELECT p_partkey AS k, 'W' || p_partkey AS record_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '10.1000/p' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR END AS pmid, (1990 + p_size)::INT AS year, CASE WHEN p_partkey % 10 = 0 THEN 'flagged' ELSE 'not_flagged' END AS flag, p_size % 3 + 1 AS refs FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 9 > 0)"


@query(f"WITH {_WORKS} SELECT record_id, title, doi, pmid, year, flag FROM w")
def q_graph_works(spark, sf):
    return lookups.graph_works(_works(spark, sf)).select("record_id", "title", "doi", "pmid", "year", "flag")


@query(f"""WITH {_WORKS}, e AS (SELECT k, unnest(range(1, refs + 1)) AS i FROM w), l AS (SELECT a.pmid AS src, b.pmid AS dst, i AS pos, b.k AS bk, a.k AS ak FROM e JOIN w a ON a.k = e.k LEFT JOIN w b ON b.k = e.k + e.i)
SELECT src, count(*) FILTER (dst IS NOT NULL) AS linked, count(*) FILTER (dst IS NULL) AS without, 'backward' AS direction FROM l WHERE src IS NOT NULL GROUP BY src
UNION ALL SELECT dst, count(*) FILTER (src IS NOT NULL), count(*) FILTER (src IS NULL), 'forward' FROM l WHERE dst IS NOT NULL GROUP BY dst""")
def q_work_graph(spark, sf):
    works = saved(lookups.graph_works(_works(spark, sf)), "works")
    links = snowball.work_graph(lookups.work_edges(works), works)
    return links.groupBy("src", "direction").agg(F.count("dst").alias("linked"), F.count_if(F.col("dst").isNull()).alias("without"))


@query("""WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://openalex.org/W' || doc_id WHEN 1 THEN 'doi:10.1000/P' || doc_id WHEN 2 THEN 'pmid:' || doc_id ELSE '?' END AS identifier FROM documents),
w AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 9 > 0)
SELECT identifier, CASE WHEN doc_id % 4 = 3 THEN 'unsupported identifier' WHEN k IS NULL OR (doc_id % 4 = 1 AND k % 2 = 1) OR (doc_id % 4 = 2 AND k % 3 > 0) THEN 'not found' END AS error FROM i LEFT JOIN w ON k = doc_id""")
def q_resolve_works(spark, sf):
    k = F.col("doc_id")
    wanted = read(spark, sf, "documents").select(F.when(k % 4 == 0, F.concat(F.lit("https://openalex.org/W"), k)).when(k % 4 == 1, F.concat(F.lit("doi:10.1000/P"), k)).when(k % 4 == 2, F.concat(F.lit("pmid:"), k)).otherwise("?").alias("identifier"))
    return lookups.resolve_works(wanted, lookups.graph_works(_works(spark, sf))).select("identifier", "error")


@query("""WITH l AS (SELECT l_orderkey AS src, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CASE WHEN l_partkey % 4 > 0 THEN l_partkey END AS dst, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT src::VARCHAR AS src, count(DISTINCT dst) AS linked, max(total) AS total, count(*) FILTER (dst IS NULL) AS without, max(total) > 3 AS truncated FROM l WHERE pos <= 3 GROUP BY src""")
def q_link_neighbours(spark, sf):
    """Lines of an order as its links, two a page; parts of every fourth key have no PMID."""
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("x"))
    hits = l.groupBy("o").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count("*").alias("n"))
    pages = hits.select("o", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(2)), lambda i: F.slice("xs", i + 1, 2))).alias("page", "xs"))
    item = F.transform("xs", lambda x: F.struct(F.when(x["l_partkey"] % 4 > 0, "MED").otherwise("PPR").alias("source"), x["l_partkey"].cast("string").alias("id")))
    body = F.to_json(F.struct(F.col("n").alias("hitCount"), F.struct(item.alias("reference")).alias("referenceList")))
    n = lookups.neighbours(lookups.link_pages(pages.select(F.col("o").cast("string").alias("key"), "page", body.alias("body")), "references"), 3)
    return n.select("src", F.size("dsts").cast("long").alias("linked"), "total", "without", "truncated")


@query("""WITH a AS (SELECT user_id % 300 AS k, event_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_id % 5 = 0 AS listed FROM events), l AS (SELECT k, arg_max(status, event_id) AS status, arg_max(listed, event_id) AS listed FROM a GROUP BY k), w AS (SELECT unnest(range(0, 320)) AS k)
SELECT w.k::VARCHAR AS key, CASE WHEN l.k IS NULL THEN 'not archived' WHEN status = 500 THEN 'status 500' WHEN listed THEN 'not a JSON object' END AS error FROM w LEFT JOIN l ON l.k = w.k""")
def q_replay(spark, sf):
    e = read(spark, sf, "events")
    a = e.select((F.col("user_id") % 300).cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")).alias("body"))
    return lookups.replay(spark.range(320).select(F.col("id").cast("string").alias("key")), a).select("key", "error")


@query("""WITH o AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT '10.1000/c' || c AS key, CASE WHEN c % 6 = 0 THEN 'truncated' WHEN c % 7 = 0 THEN 'item not bound' END AS failure, CASE WHEN c % 6 > 0 AND c % 7 > 0 THEN n ELSE 0 END AS notices FROM o""")
def q_update_notices(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("os"))
    doi = F.concat(F.lit("10.1000/C"), "c")
    item = F.transform("os", lambda x, i: F.struct(F.array(F.struct(F.when((F.col("c") % 7 == 0) & (i == 0), "10.9/other").otherwise(doi).alias("DOI"), F.when(x["o_orderstatus"] == "F", "retraction").otherwise("update").alias("type"), _null().alias("label"))).alias("update-to")))
    body = F.to_json(F.struct(F.struct((F.size("os") + F.when(F.col("c") % 6 == 0, 1).otherwise(0)).alias("total-results"), item.alias("items")).alias("message")))
    notices, looked = lookups.update_notices(o.select(doi.alias("key"), F.lit(1).alias("seq"), F.lit(200).alias("status"), body.alias("body")))
    n = notices.groupBy("target").agg(F.count("*").alias("n"))
    return looked.join(n, F.col("key") == F.col("target"), "left").select("key", "failure", F.coalesce("n", F.lit(0)).alias("notices"))


@query("""SELECT p_partkey, '10.1000/p' || p_partkey AS key, least(p_size % 4, 3)::BIGINT AS dois, (p_size % 4 + p_size % 3)::BIGINT AS deposited FROM part""")
def q_reference_dois(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    named = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < s % 4), lambda i: F.struct(F.concat(F.lit("https://doi.org/10.1/"), i).alias("DOI")))
    bare = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < s % 3), lambda i: F.struct(F.lit("none").alias("DOI")))
    body = F.to_json(F.struct(F.struct(F.concat(F.lit("10.1000/P"), k).alias("DOI"), F.array("p_name").alias("title"), F.concat(named, bare).alias("reference")).alias("message")))
    works = lookups.registry_works(read(spark, sf, "part").select(F.concat(F.lit("10.1000/P"), k).alias("key"), F.lit(1).alias("seq"), F.lit(200).alias("status"), body.alias("body")))
    return lookups.reference_dois(works).select(F.substring("key", 10, 20).cast("long").alias("p_partkey"), "key", F.size("dois").cast("long").alias("dois"), "deposited")


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 400 END AS pmid, CASE WHEN doc_id % 3 = 0 THEN '10.1/own' END AS doi FROM documents), c AS (SELECT c_custkey AS pmid, '10.1/c' || c_custkey AS doi, c_custkey % 5 = 0 AS open FROM customer WHERE c_custkey < 300)
SELECT doc_id, coalesce(r.doi, c.doi) AS doi, CASE WHEN c.open THEN 'open' ELSE 'unknown' END AS access FROM r LEFT JOIN c ON c.pmid = r.pmid""")
def q_enrich_core(spark, sf):
    k = F.col("doc_id")
    r = read(spark, sf, "documents").select(k, F.when(k % 2 == 0, (k % 400).cast("string")).alias("pmid"), F.when(k % 3 == 0, "10.1/own").alias("doi"), _null().alias("pmcid"), F.lit("unknown").alias("access"), _null().alias("abstract"), _null().alias("license"))
    c = read(spark, sf, "customer").where("c_custkey < 300")
    n = F.col("c_custkey")
    item = F.struct(n.cast("string").alias("id"), n.cast("string").alias("pmid"), F.col("c_name").alias("title"), F.concat(F.lit("10.1/C"), n).alias("doi"), F.when(n % 5 == 0, "Y").otherwise("N").alias("isOpenAccess"))
    answer = c.groupBy((n % 7).alias("b")).agg(F.collect_list(item).alias("result")).select(F.concat(F.lit("batch"), "b").alias("key"), F.lit(1).alias("seq"), F.lit(200).alias("status"), F.to_json(F.struct(F.struct("result").alias("resultList"))).alias("body"))
    return lookups.enrich(r, lookups.core_records(r.select("pmid").where("pmid is not null"), answer)).select("doc_id", "doi", "access")


# --- verification --------------------------------------------------------------------------------------------------------------

_OTHER = "0000 0000 0000"


def _verified(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part")
    doi = lambda c: F.concat(F.lit("10.1000/p"), c)
    records = p.select(k.cast("string").alias("rec"), F.col("p_name").alias("title"), F.when(k % 3 > 0, F.concat(F.lit("https://doi.org/"), doi(k))).alias("doi"), F.when(k % 4 == 0, k.cast("string")).alias("pmid"), F.when(k % 8 == 0, F.array(F.lit("pubmed"))).when(k % 4 == 0, F.array(F.lit("europe_pmc"))).otherwise(F.array(F.lit("crossref"))).alias("sources"), F.when(k % 40 == 0, F.array(F.lit("Retracted Publication"))).otherwise(F.array().cast("array<string>")).alias("types"), F.when(k % 50 == 1, F.array(F.lit("before"))).alias("conflicts"))
    works = p.where(k % 5 > 0).select(doi(k).alias("key"), F.when(k % 11 == 0, "10.1/other").otherwise(doi(k)).alias("doi"), F.when(k % 13 == 0, _OTHER).otherwise(F.col("p_name")).alias("title"), _null().alias("type"), _null().alias("subtype"), F.lit(None).cast("array<struct<type:string,label:string>>").alias("updates"), F.when(k % 17 == 0, F.create_map(F.lit("is-corrected-by"), F.array().cast("array<struct<type:string,label:string>>"))).alias("relation"))
    notices = p.where(k % 19 == 0).select(doi(k).alias("target"), F.lit("expression_of_concern").alias("type"), _null().alias("label"))
    relations = p.where(k % 28 == 0).select(k.cast("string").alias("pmid"), F.lit("ErratumIn").alias("ref_type"))
    look = lambda kind, key, bad: p.select(F.lit(kind).alias("kind"), key.alias("key"), _null().alias("failure"), F.lit("2025-01-01").alias("retrieved_at"), F.when(bad, "short").otherwise(F.sha2(key, 256)).alias("response_sha256"), F.lit("https://x").alias("url"))
    return verify.verify(records, works, notices, relations, look("updates", doi(k), k % 23 == 0).unionByName(look("relations", k.cast("string"), k % 36 == 0)))


_VERIFIED = f"""b AS (SELECT p_partkey AS k, p_partkey % 3 > 0 AS has_doi, p_partkey % 4 = 0 AS has_pmid, p_partkey % 8 = 0 AS registry, p_partkey % 3 > 0 AND p_partkey % 5 > 0 AS worked FROM part),
c AS (SELECT *, p_cf, worked AND k % 11 = 0 AS c1, worked AND k % 13 = 0 AS c2, worked AND k % 23 > 0 AS ups, has_pmid AND k % 36 > 0 AS rel FROM (SELECT *, k % 50 = 1 AS p_cf FROM b)),
d AS (SELECT *, p_cf OR c1 OR c2 AS clash, (NOT has_doi OR ups) AND (NOT has_pmid OR rel) AS complete, CASE WHEN k % 40 = 0 THEN 3 WHEN ups AND k % 19 = 0 THEN 2 WHEN (worked AND k % 17 = 0) OR (rel AND k % 28 = 0) THEN 1 ELSE 0 END AS grave FROM c),
v AS (SELECT *, CASE WHEN clash THEN 'metadata_conflict' WHEN worked THEN 'cross_source_verified' WHEN registry THEN 'authoritative_id_verified' WHEN has_doi THEN 'unverified' WHEN has_pmid THEN 'authoritative_id_verified' ELSE 'unverified' END AS verification FROM d)"""


@query(f"""WITH {_VERIFIED} SELECT k::VARCHAR AS rec, verification, CASE grave WHEN 3 THEN 'retracted' WHEN 2 THEN 'expression_of_concern' WHEN 1 THEN 'correction' ELSE 'unknown' END AS status, complete, p_cf::INT + c1::INT + c2::INT AS conflicts, grave = 0 AND complete AND NOT clash AND verification <> 'unverified' AS ready FROM v""")
def q_verify(spark, sf):
    return _verified(spark, sf)[0].select("rec", "verification", "status", "complete", F.size("conflicts").alias("conflicts"), "ready")


@query(f"""WITH {_VERIFIED} SELECT k::VARCHAR AS rec, 'crossref' AS source FROM v WHERE worked AND NOT ups UNION ALL SELECT k::VARCHAR, 'pubmed' FROM v WHERE has_pmid AND NOT rel""")
def q_verify_issues(spark, sf):
    return _verified(spark, sf)[1].select("rec", "source")


@query("""WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS rank, CASE event_type WHEN 'view' THEN 'pubmed' WHEN 'click' THEN 'crossref' WHEN 'error' THEN 'europe_pmc' ELSE 'other' END AS source, (event_id % 3)::VARCHAR AS value FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank, source, lpad(event_id::VARCHAR, 12, '0')) AS place FROM o) SELECT user_id::VARCHAR AS rec, arg_min(value, place) AS selected, count(*) - 1 AS alternatives, count(DISTINCT value) > 1 AS conflict FROM k GROUP BY user_id""")
def q_field_decision(spark, sf):
    kind = F.col("event_type")
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("rec"), F.when(kind == "view", "pubmed").when(kind == "click", "crossref").when(kind == "error", "europe_pmc").otherwise("other").alias("source"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("evidence_id"), (F.col("event_id") % 3).cast("string").alias("pmid"))
    d = verify.decide_fields(verify.observations(e, "pmid"))
    return d.select("rec", F.col("selected.value").alias("selected"), F.size("alternatives").cast("long").alias("alternatives"), "conflict")


@query("""WITH r AS (SELECT p_partkey AS k FROM part) SELECT k::VARCHAR AS rec, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'status_evidence_unresolved' END, CASE WHEN k % 5 = 0 THEN 'needs_one_crossref_status' END,
CASE WHEN k % 5 > 0 AND k % 7 = 0 THEN 'crossref_status_target_differs' END, CASE WHEN k % 5 > 0 AND k % 11 = 0 THEN 'status_evidence_lacks_digest' END, CASE WHEN k % 5 > 0 AND k % 11 > 0 AND k % 13 = 0 THEN 'status_evidence_not_archived' END], lambda x: x IS NOT NULL)) AS error FROM r""")
def q_record_semantics(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part")
    doi = F.concat(F.lit("10.1000/p"), k)
    digest = F.sha2(k.cast("string"), 256)
    one = F.struct(F.when(k % 5 == 0, "e0").otherwise("e1").alias("evidence_id"), F.lit("crossref_status").alias("source"), doi.alias("record_id"), F.when(k % 7 == 0, "10.1/x").otherwise(F.concat(F.lit("https://doi.org/"), F.upper(doi))).alias("doi"), _null().alias("pmid"), F.when(k % 11 == 0, "short").otherwise(digest).alias("response_sha256"))
    r = p.select(k.cast("string").alias("rec"), doi.alias("doi"), _null().alias("pmid"), F.array(one).alias("evidence"), F.array(F.lit("e1")).alias("status_ids"), F.lit(True).alias("complete"), F.lit(True).alias("ready"))
    return verify.semantic_errors(r, p.where(k % 13 > 0).select(digest.alias("response_sha256")))


@query("""WITH l AS (SELECT p_partkey AS rec, unnest(['u2', 'u1', 'u1']) AS url, unnest([CASE WHEN p_size % 2 = 0 THEN 'am' END, CASE WHEN p_size % 3 = 0 THEN 'vor' END, CASE WHEN p_size % 3 = 0 THEN 'vor' END]) AS v FROM part),
c AS (SELECT DISTINCT rec, url, CASE WHEN v = 'vor' THEN 'cc by' WHEN v IS NULL THEN 'cc0' END AS license_text, CASE v WHEN 'am' THEN 'acceptedVersion' WHEN 'vor' THEN 'publishedVersion' END AS version FROM l)
SELECT rec::VARCHAR AS rec, row_number() OVER (PARTITION BY rec ORDER BY url, coalesce(license_text, ''), coalesce(version, '')) AS position, url, license_text, version FROM c""")
def q_license_candidates(spark, sf):
    s = F.col("p_size")
    link = lambda url, v: F.struct(F.lit(url).alias("URL"), v.alias("content-version"))
    vor = F.when(s % 3 == 0, "vor")
    body = F.to_json(F.struct(F.array(link("u2", F.when(s % 2 == 0, "am")), link("u1", vor), link("u1", vor)).alias("link"), F.array(link("cc by", F.lit("vor")), link("cc0", _null())).alias("license")))
    return licences.discover(read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("rec"), F.lit("crossref").alias("kind"), body.alias("body"))).select("rec", "position", "url", "license_text", "version")


@query("""SELECT '10.1000/p' || p_partkey AS target, CASE WHEN p_partkey % 4 > 0 THEN CASE p_size % 3 WHEN 0 THEN 'retracted' WHEN 1 THEN 'correction' ELSE 'unknown' END WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE CASE WHEN p_size % 5 = 0 THEN 'expression_of_concern' ELSE 'unknown' END END AS status,
NOT (p_partkey % 4 = 0 AND p_partkey % 3 = 0) AS complete, CASE WHEN p_partkey % 4 > 0 THEN 'configured_provider' WHEN p_partkey % 3 = 0 THEN 'none' ELSE 'crossref_public_rest_fallback' END AS route FROM part""")
def q_crossmark_assess(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    doi = F.concat(F.lit("10.1000/p"), k)
    p = read(spark, sf, "part")

    def say(route, provider, kind, status, body):
        return p.select(doi.alias("target"), F.lit(route).alias("route"), F.lit(provider).alias("provider"), F.lit(kind).alias("kind"), status.alias("status_code"), F.lit("u").alias("url"), F.lit("t").alias("retrieved_at"), F.to_json(body).cast("binary").alias("body"))

    kinds = F.when(s % 3 == 0, F.array(F.lit("erratum"), F.lit("Partial Retraction"))).when(s % 3 == 1, F.array(F.lit("corrigendum"))).otherwise(F.array(F.lit("addendum")))
    own = say("provider", "p", crossmark.PROVIDER, F.when(k % 4 == 0, 503).otherwise(200), F.struct(doi.alias("target_doi"), F.transform(kinds, lambda t: F.struct(doi.alias("target_doi"), t.alias("type"))).alias("updates")))
    work = say("fallback", "c", crossmark.WORK, F.lit(200), F.struct(F.struct(F.when(k % 3 == 0, "10.1/x").otherwise(doi).alias("DOI")).alias("message")))
    ups = say("fallback", "c", crossmark.UPDATES, F.lit(200), F.struct(F.struct(F.lit(1).alias("total-results"), F.array(F.struct(F.array(F.struct(doi.alias("DOI"), F.when(s % 5 == 0, "Expression-of concern").otherwise("x").alias("type"))).alias("update-to"))).alias("items")).alias("message")))
    return crossmark.assess(p.select(doi.alias("target")), own.unionByName(work).unionByName(ups)).select("target", "status", "complete", "route")


# --- claims, official sources, access --------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10) || chr(10)) AS t, turn % 3 + 1 AS a, turn % 3 + 1 + conv_id % 2 AS b FROM conversations), p AS (SELECT *, list_filter(string_split_regex(t, '\\n[ \\t\\r\\n]*\\n'), lambda x: trim(x) <> '') AS ps FROM c)
SELECT conv_id, turn, CASE WHEN b > len(ps) THEN 'out_of_bounds' ELSE 'located' END AS status, CASE WHEN b <= len(ps) THEN sha256(array_to_string(ps[a:b], chr(10) || chr(10))) END AS excerpt_sha256 FROM p""")
def q_locate_paragraphs(spark, sf):
    c = read(spark, sf, "conversations").withColumn("t", F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")))
    low = F.col("turn") % 3 + 1
    anchor = F.concat(low.cast("string"), F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("-"), (low + 1).cast("string"))).otherwise(""))
    at = claims.locate(F.lit("paragraph"), anchor, F.col("t"))
    return c.withColumn("at", at).select("conv_id", "turn", F.col("at.status").alias("status"), F.sha2("at.excerpt", 256).alias("excerpt_sha256"))


@query("""WITH b AS (SELECT item_id, text, substr(text, 1, 20) AS quote, (length(text) - length(replace(text, substr(text, 1, 20), ''))) / 20 AS n FROM benchmark)
SELECT item_id::VARCHAR AS claim_id, CASE WHEN item_id % 5 = 0 THEN 'material_sha256' WHEN item_id % 7 = 0 THEN 'text' WHEN item_id % 11 = 0 THEN 'anchor_kind' WHEN n <> 1 THEN 'locator_ambiguous' END AS rejected,
CASE WHEN item_id % 5 > 0 AND item_id % 7 > 0 AND item_id % 11 > 0 AND n = 1 THEN sha256(quote) END AS excerpt_sha256, CASE WHEN item_id % 5 > 0 AND item_id % 7 > 0 AND item_id % 11 > 0 AND n = 1 THEN 'AMBIGUOUS' END AS support FROM b""")
def q_bind_claims(spark, sf):
    k = F.col("item_id")
    b = read(spark, sf, "benchmark")
    rows = b.select(k.cast("string").alias("claim_id"), F.lit("a claim").alias("claim_text"), F.col("text").cast("binary").alias("material"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.when(k % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("expected_sha256"), F.concat(F.lit("ev-"), F.substring(F.md5("text"), 1, 20)).alias("evidence_id"), F.when(k % 11 == 0, "section").otherwise("quote").alias("anchor_kind"), F.substring("text", 1, 20).alias("anchor_value"), F.when(k % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text"), F.lit("SUPPORTED").alias("support"))
    return claims.bind(rows).select("claim_id", "rejected", "excerpt_sha256", "support")


def _logged(spark, sf):
    """Conversations as logs of attestations, one JSON object a line; by conv_id one line is altered, not a known type, or not JSON."""
    c = read(spark, sf, "conversations")
    import pandas as pd  # noqa: F401  the fold below is given pandas frames

    def chain(pdf):
        import hashlib
        import json

        import pandas

        last, out = claims.GENESIS, []
        for n, (conv, text) in enumerate(pdf.sort_values(["turn", "text"])[["conv_id", "text"]].itertuples(index=False), 1):
            e = {"actor_type": "claimed_human", "attestation_method": "unverified_cli_claim", "event_type": "X" if n == 3 and conv % 4 == 1 else claims.ATTESTED, "identity_verified": False, "note": text, "previous_event_hash": last}
            dump = lambda o: json.dumps(o, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            last = hashlib.sha256(dump(e).encode()).hexdigest()
            e["event_hash"] = last
            if n == 2 and conv % 4 == 0:
                e["note"] = text + "!"
            out.append((conv, n, "{" if n == 2 and conv % 4 == 2 else dump(e)))
        return pandas.DataFrame(out, columns=["log", "line", "value"])

    return c.groupBy("conv_id").applyInPandas(chain, "log long, line int, value string")


@query("""WITH o AS (SELECT conv_id AS log, count(*) AS n FROM conversations GROUP BY 1), f AS (SELECT log, n, CASE WHEN log % 4 IN (0, 2) AND n >= 2 THEN 2 WHEN log % 4 = 1 AND n >= 3 THEN 3 END AS failed_line, CASE log % 4 WHEN 0 THEN 'event_hash' WHEN 2 THEN 'invalid_json' WHEN 1 THEN 'event_type' END AS why FROM o)
SELECT log, failed_line IS NULL AS valid, coalesce(failed_line - 1, n) AS events, failed_line, CASE WHEN failed_line IS NOT NULL THEN why END AS failure FROM f""")
def q_attestation_logs(spark, sf):
    return claims.verify_logs(_logged(spark, sf))


@query("""WITH u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^http:', 'https:') WHEN page_id % 5 = 1 THEN 'https://www.example.org/a/' || page_id WHEN page_id % 5 = 2 THEN 'https://example.org/ab/' || page_id WHEN page_id % 5 = 3 THEN 'https://other.org/x/' || page_id ELSE 'https://www.other.org/x' END AS url FROM pages WHERE page_id % 5 > 0)
SELECT page_id::VARCHAR AS title, CASE page_id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'outside' WHEN 3 THEN NULL ELSE 'outside' END AS error, CASE page_id % 5 WHEN 1 THEN '/a' WHEN 3 THEN '/' END AS prefix, sha256(url) AS url_sha256 FROM u""")
def q_official_candidates(spark, sf):
    k = F.col("page_id")
    rule = "organization_id string, rules array<struct<hostname:string,path_prefixes:array<string>,include_subdomains:boolean>>"
    regs = spark.createDataFrame([("org", [("example.org", ["/b", "/a/"], True), ("Other.org", ["/"], False)])], rule)
    urls = F.when(k % 5 == 1, F.concat(F.lit("https://WWW.example.org/a/"), k)).when(k % 5 == 2, F.concat(F.lit("https://example.org:443/ab/"), k)).when(k % 5 == 3, F.concat(F.lit("https://other.org/x/"), k, F.lit("#f"))).otherwise("https://www.other.org/x")
    asked = read(spark, sf, "pages").where(k % 5 > 0).select(F.lit(" Org").alias("organization_id"), urls.alias("url"), k.cast("string").alias("title"))
    return official.propose(asked, regs).select("title", "error", "prefix", "url_sha256")


#: A small profile.
PROFILE = {"institution": "U", "webvpn_portal": "https://vpn.example/", "platforms": [{"name": "alpha", "entry_url": "https://login.example/a", "doi_prefixes": ["10.1000"], "hosts": ["site1.example"]}, {"name": "beta", "entry_url": "https://login.example/b", "doi_prefixes": ["10.2000/x"], "hosts": ["org", "example.com"]}]}


@query("""WITH p AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '([^@]*)$', 1), ':[0-9]*$', '')) AS host FROM pages),
m AS (SELECT page_id, CASE WHEN page_id % 4 = 0 OR host = 'site1.example' OR host LIKE '%.site1.example' THEN 'alpha' WHEN page_id % 4 = 1 OR host = 'org' OR host LIKE '%.org' OR host = 'example.com' OR host LIKE '%.example.com' THEN 'beta' ELSE '' END AS platform FROM p)
SELECT page_id AS seq, platform, CASE WHEN platform = '' THEN 'webvpn_then_doi' ELSE 'federated_login' END AS route, CASE platform WHEN 'alpha' THEN 'https://login.example/a' WHEN 'beta' THEN 'https://login.example/b' ELSE 'https://vpn.example/' END AS entry_url FROM m""")
def q_access_plan(spark, sf):
    k = F.col("page_id")
    rows = read(spark, sf, "pages").select(k.alias("seq"), F.lit("t").alias("title"), F.when(k % 4 == 0, F.concat(F.lit("10.1000/"), k)).when(k % 4 == 1, F.concat(F.lit("10.2000/X/"), k)).when(k % 4 == 2, F.concat(F.lit("10.10001/"), k)).alias("doi"), _null().alias("pmid"), F.col("url").alias("landing_url"))
    return access.plan(rows, access.parse_profile(PROFILE)).select("seq", "platform", "route", "entry_url")


# --- audits, reports, batches -----------------------------------------------------------------------------------------------------

_SCHEMA = {"type": "object", "required": ["k", "s"], "additionalProperties": False, "properties": {"k": {"$ref": "#/d/n"}, "s": {"type": "string", "pattern": "^o", "maxLength": 5}, "l": {"type": "array", "minItems": 1, "items": {"$ref": "#/d/n"}}}, "d": {"n": {"type": "integer", "minimum": 10}}, "if": {"properties": {"s": {"const": "one"}}}, "then": {"required": ["l"]}}


@query("""WITH e AS (SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events)
SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN event_id % 3 = 0 THEN '$: required s' END, CASE WHEN k < 10 THEN '$.k: minimum' END, CASE WHEN event_id % 3 = 2 THEN '$.s: pattern' END, CASE WHEN event_id % 3 IN (0, 1) AND event_id % 2 = 0 THEN '$: required l' END, CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN '$.l: minItems' END], lambda x: x IS NOT NULL)), ',') AS errors FROM e""")
def q_schema_rules(spark, sf):
    k = F.col("event_id")
    v = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(k % 3 == 1, "one").when(k % 3 == 2, "two").alias("s"), F.when((k % 2 == 1) & (k % 5 == 0), F.array().cast("array<long>")).when(k % 2 == 1, F.array(F.lit(11).cast("long"))).alias("l"))
    rows = read(spark, sf, "events").select("event_id", F.to_json(v).alias("body"))
    return release.validate(rows, "body", _SCHEMA).select("event_id", F.array_join(F.array_sort("errors"), ",").alias("errors"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'my-Token' WHEN event_id % 3 = 1 THEN 'PASSWORD' END AS name FROM events WHERE event_id % 3 < 2""")
def q_forbidden_keys(spark, sf):
    k = F.col("event_id")
    body = F.when(k % 3 == 0, F.format_string('{"a": [{"my-Token": %d}], "b": "password: x"}', k)).when(k % 3 == 1, F.lit('{"x": {"y": {"PASSWORD": {}}}}')).otherwise(F.lit('{"a": "token", "b": ["cookie: 1"]}'))
    return read(spark, sf, "events").select(k, F.explode(validate.forbidden_keys(body)).alias("name"))


@query("""SELECT page_id, 'Accept,X-Other' AS names FROM pages""")
def q_safe_headers(spark, sf):
    h = F.create_map(*(F.lit(x) for n in ("Accept", "Authorization", "Cookie", "User-Agent", "X-Api-Key", "X-Email", "X-Other") for x in (n, "v")))
    return read(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(F.map_keys(store.safe_headers(h))), ",").alias("names"))


@query("""SELECT (SELECT count(*) FROM documents) AS returned, (SELECT count(*) FROM labels WHERE quality = 1) AS citation_ready, (SELECT count(DISTINCT user_id % 40) FROM events) AS sources, (SELECT count(*) FROM events) AS total_available, (SELECT count(*) FROM pages WHERE page_id % 50 = 0) AS issues,
(SELECT bool_or(event_type = 'error' AND event_id % 50 = 0) FROM events) OR (SELECT count(*) FROM pages WHERE page_id % 50 = 0) > 0 AS partial, NOT (SELECT bool_or(event_type = 'error' AND event_id % 50 = 0) FROM events) AS search_complete""")
def q_run_manifest(spark, sf):
    records = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select((F.col("quality") == 1).alias("ready"))
    pages = read(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("run")).agg(F.count("*").alias("total_available"), F.bool_or((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)).alias("bad")).select("run", "total_available", F.when(F.col("bad"), "partial").otherwise("complete").alias("state"))
    return reports.manifest(records, pages, read(spark, sf, "pages").where("page_id % 50 = 0"))


@query("""SELECT o_orderkey, 'a0, a1, a2, a3, a4, a5'[1 : least(o_orderkey % 9, 6) * 4 - 2] || CASE WHEN o_orderkey % 9 > 6 THEN ', et al.' ELSE '' END AS line FROM orders WHERE o_orderkey % 9 > 0""")
def q_author_line(spark, sf):
    k = F.col("o_orderkey")
    names = F.transform(F.sequence(F.lit(0), (k % 9 - 1).cast("int")), lambda i: F.concat(F.lit("a"), i))
    return read(spark, sf, "orders").where(k % 9 > 0).select(k, reports.author_line(names).alias("line"))


@query("""WITH t AS (SELECT p_partkey AS ref, substr('Quilt study of ' || p_name, 1, 500) AS q, 'Smith' AS a, 1990 + p_size AS y, p_size % 2 = 0 AS named FROM part)
SELECT ref, 1 AS step, q || '[Title]' AS query FROM t UNION ALL SELECT ref, 2, a || '[Author] AND ' || q || '[Title] AND ' || y || '[dp]' FROM t WHERE named UNION ALL SELECT ref, 4, 'TITLE:"' || q || '"' FROM t""")
def q_ref_queries(spark, sf):
    s = F.col("p_size")
    refs = read(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.concat(F.lit("Quilt study of "), F.col("p_name")).alias("title"), F.lit("raw").alias("raw"), F.lit("Smith").alias("author"), F.when(s % 2 == 0, s + 1990).alias("year"))
    return pdfrefs.queries(refs).select("ref", "step", "query")


@query("""WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, min(turn) OVER (PARTITION BY conv_id) AS low FROM conversations) SELECT conv_id AS doc, (turn - low)::INT AS number, (turn - low)::INT AS page FROM c WHERE turn > low""")
def q_page_references(spark, sf):
    """A conversation as a document of a page a turn: the first has the heading, each later one opens the reference of its number."""
    from pyspark.sql import Window

    c = read(spark, sf, "conversations")
    at = (F.col("turn") - F.min("turn").over(Window.partitionBy("conv_id"))).cast("int")
    text = F.when(at == 0, F.concat("text", F.lit("\nReferences\n"))).otherwise(F.concat(F.lit("["), at.cast("string"), F.lit("] "), F.regexp_replace("text", r"[\[\]\n]", " ")))
    pages = saved(c.select(F.col("conv_id").alias("doc"), at.alias("page"), text.alias("text")), "pages")
    return pdfrefs.references(pages).select("doc", "number", "page")


@query()
def q_ref_candidates(spark, sf):
    """Parts as references, and as candidates with a word changed in some, by shared runs of title words."""
    k, s = F.col("p_partkey"), F.col("p_size")
    p = read(spark, sf, "part")
    title = F.concat("p_name", F.lit(" study number "), k, F.lit(" of "), "p_type")
    fields = lambda changed: (F.when(changed, F.concat(title, F.lit(" revised"))).otherwise(title).alias("title"), F.lit("Smith").alias("author"), (s + 1990).alias("year"), F.col("p_brand").alias("journal"), F.when(k % 5 == 0, F.concat(F.lit("10.1/"), k)).alias("doi"))
    out = pdfrefs.candidates(p.select(k.alias("ref"), *fields(F.lit(False))), p.select(k.alias("pub"), *fields(k % 4 == 0)), 3)
    return out.select("ref", "pub", "score", "decision", "place")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 > 0 THEN 'a failed lookup has no match status' WHEN event_id % 4 IN (1, 2) AND event_id % 3 <> 1 THEN 'a match status is required' WHEN event_id % 4 = 3 THEN 'status must be completed, partial or failed' END AS error FROM events""")
def q_outcomes(spark, sf):
    k = F.col("event_id")
    execution = F.when(k % 4 == 0, "failed").when(k % 4 == 1, "completed").when(k % 4 == 2, "partial")
    match = F.when(k % 3 == 1, "not_matched").when(k % 3 == 2, "perhaps")
    return read(spark, sf, "events").select(k, validate.outcome_error(execution, match).alias("error"))


@query("""WITH s AS (SELECT c_custkey AS k FROM customer), e AS (SELECT user_id AS k, arg_max(event_type, event_id) AS t, count(*) FILTER (event_type IN ('click', 'view')) AS attempts FROM events GROUP BY 1)
SELECT s.k::VARCHAR AS reference_id, (coalesce(attempts, 0) + 1) AS attempt FROM s LEFT JOIN e ON e.k = s.k WHERE coalesce(t, '') <> 'purchase' ORDER BY s.k LIMIT 100""")
def q_next_work(spark, sf):
    from ..streaming import ledger
    from .catalogue import _ledger

    states = ledger.latest(_ledger(spark, sf))
    chosen = read(spark, sf, "customer").select(F.col("c_custkey").alias("position"), F.col("c_custkey").alias("reference_id"))
    return batch.next_work(chosen, states, 100).select(F.col("reference_id").cast("string").alias("reference_id"), "attempt")  # a budget of items, as asked for


@query("""WITH c AS (SELECT unnest(range(0, 240)) AS i) SELECT ['retraction', 'correction', 'expression_of_concern', 'metadata_conflict', 'missing_identifier', 'truncated_lookup', 'license_unknown', 'duplicate_record'][i % 8 + 1] AS category, count(*) AS n, count(*) FILTER (i % 8 IN (0, 1, 2)) AS with_status FROM c GROUP BY 1""")
def q_synthetic_cases(spark, sf):
    return release.synthetic_cases(spark).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("expected_publication_status") != "unknown").alias("with_status"))


@query("""SELECT event_id, sha256('{"a":[' || event_id || ',null],"k":' || (props ->> '$.k') || ',"z":"é"}') AS digest FROM events""")
def q_canonical_json(spark, sf):
    body = F.format_string('{ "z": "é", "k" : %s, "a": [%d, null] }', F.get_json_object("props", "$.k"), F.col("event_id"))
    return read(spark, sf, "events").select("event_id", F.sha2(canonical_json(body), 256).alias("digest"))


@query("""SELECT event_id, event_id % 6 < 2 AS valid FROM events""")
def q_timestamps(spark, sf):
    k = F.col("event_id") % 6
    t = F.when(k == 0, "2025-02-28T01:02:03Z").when(k == 1, "2025-02-28T01:02:03.25+05:30").when(k == 2, "2025-02-28T01:02:03").when(k == 3, "2025-02-31T01:02:03Z").when(k == 4, "28.2.2025")
    return read(spark, sf, "events").select("event_id", validate.timestamp(t).alias("valid"))


# --- expansion --------------------------------------------------------------------------------------------------------------------


def _citing(spark, sf):
    """Orders cite the next orders of their customer; documents are their records, by the order's key."""
    from pyspark.sql import Window

    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    two = o.withColumns({"b1": F.lead("o_orderkey", 1).over(w), "b2": F.lead("o_orderkey", 2).over(w)})
    pairs = two.select(F.col("o_orderkey").alias("a"), F.explode(F.array_compact(F.array("b1", "b2"))).alias("b"))

    def side(src, dst, way):
        s = Window.partitionBy(src)
        return pairs.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.row_number().over(s.orderBy(dst)).alias("pos"), F.count("*").over(s).alias("total"), F.lit(way).alias("direction"))

    core = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), _null().alias("doi"), F.concat(F.lit("the work on item number "), F.col("o_orderkey")).alias("title"), _null().alias("abstract"))
    return saved(side("a", "b", snowball.BACKWARD).unionByName(side("b", "a", snowball.FORWARD)), "links"), core


_PATHS = """RECURSIVE o AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), s AS (SELECT * FROM o WHERE k < 40),
r AS (SELECT o.k, min(ceil(abs(o.i - s.i) / 2.0)) AS round FROM o JOIN s ON s.o_custkey = o.o_custkey GROUP BY o.k)"""


@query(f"""WITH {_PATHS} SELECT k::VARCHAR AS pmid, round::INT AS round FROM r WHERE round BETWEEN 1 AND 3""")
def q_expand(spark, sf):
    links, core = _citing(spark, sf)
    seeds = core.where("cast(pmid as long) < 40").select("pmid", "doi", "title")
    found, _ = snowball.expand(seeds, links, core, RULE.parse(["work"]), snowball.Limits(rounds=3, per_paper=10))
    return found.where("relevant").select("pmid", "round")


@query(f"""WITH {_PATHS}, n AS (SELECT round::INT AS round, count(*) AS new FROM r WHERE round BETWEEN 1 AND 3 GROUP BY 1) SELECT round, new, sum(new) OVER (ORDER BY round)::BIGINT AS cumulative_relevant, CASE WHEN round = 3 THEN 'round_limit' ELSE '' END AS stop FROM n""")
def q_expand_rounds(spark, sf):
    links, core = _citing(spark, sf)
    seeds = core.where("cast(pmid as long) < 40").select("pmid", "doi", "title")
    return snowball.expand(seeds, links, core, RULE.parse(["work"]), snowball.Limits(rounds=3, per_paper=10))[1].select("round", "new", "cumulative_relevant", "stop")


@query("""WITH l AS (SELECT doc_id, 'https://host.org/' || doc_id AS url, doc_id % 3 AS k FROM documents WHERE doc_id % 4 = 0) SELECT '10.1/' || doc_id AS doi, url, CASE k WHEN 0 THEN 'allowed_machine_read' WHEN 1 THEN 'restricted_link_only' ELSE 'unknown' END AS decision FROM l""")
def q_open_locations(spark, sf):
    k = F.col("doc_id")
    body = F.to_json(F.struct(F.when(k % 4 == 0, F.struct(F.lit("").alias("url_for_pdf"), F.concat(F.lit("https://host.org/"), k).alias("url"), F.when(k % 3 == 0, "cc-by").when(k % 3 == 1, "cc-by-nc").alias("license"))).alias("best_oa_location")))
    found, _ = lookups.open_locations(read(spark, sf, "documents").select(F.concat(F.lit("10.1/"), k).alias("key"), F.lit(1).alias("seq"), F.when(k % 8 == 1, 404).otherwise(200).alias("status"), body.alias("body")))
    return found.select("doi", "url", policy.assess_license(F.col("url"), F.col("license")).alias("decision"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 > 0 AS has_doi, doc_id % 6 = 0 AS has_pmid, doc_id % 5 = 0 AND doc_id % 10 = 0 AS first, doc_id % 20 = 0 AS first_ok, doc_id % 4 > 0 AND doc_id % 3 = 0 AS second, doc_id % 7 < 3 AS free FROM documents)
SELECT doc_id::VARCHAR AS key, CASE WHEN first_ok OR (second AND free) THEN 'oa_machine_readable' WHEN first OR second THEN 'oa_link_only' WHEN has_doi OR has_pmid THEN 'needs_institutional_access' ELSE 'no_identifier' END AS category,
CASE WHEN first_ok THEN 'europe_pmc_oa' WHEN second AND free THEN 'unpaywall' WHEN first THEN 'europe_pmc_oa' WHEN second THEN 'unpaywall' END AS route,
CASE WHEN first_ok THEN 'CC BY' WHEN second AND free THEN 'cc0' WHEN second AND NOT first THEN 'cc by nc' END AS used_license FROM d""")
def q_access_decisions(spark, sf):
    k = F.col("doc_id")
    d = read(spark, sf, "documents")
    records = d.select(k.cast("string").alias("key"), F.lit("t").alias("title"), F.when(k % 4 > 0, F.concat(F.lit("10.1/"), k)).alias("doi"), F.when(k % 6 == 0, k.cast("string")).alias("pmid"), F.when(k % 5 == 0, F.concat(F.lit("PMC"), k)).alias("pmcid"), F.when(k % 10 == 0, "open").otherwise("unknown").alias("access"), F.when(k % 20 == 0, "CC BY").alias("license"))
    locations = d.where(k % 3 == 0).select(F.concat(F.lit("10.1/"), k).alias("doi"), F.concat(F.lit("https://host.org/"), k).alias("url"), _null().alias("landing_url"), F.when(k % 7 < 3, "cc0").otherwise("cc by nc").alias("license"))
    return access.decisions(records, locations).select("key", "category", "route", "used_license")


@query("""SELECT p_partkey, '@article{k' || p_partkey || ',' || chr(10) || '  title = {{' || p_name || ' \\& more \\_x\\_}},' || chr(10) || '  author = {' || replace(p_brand, '#', '\\#') || ' and B},' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '  journal = {J},' || chr(10) ELSE '' END || '  year = {' || (1990 + p_size) || '}' ||
CASE WHEN p_partkey % 2 = 0 THEN ',' || chr(10) || '  doi = {10.1000/p' || p_partkey || '}' ELSE '' END || chr(10) || '}' || chr(10) AS entry FROM part""")
def q_bibtex_entry(spark, sf):
    from ..operators.export import bibtex

    k = F.col("p_partkey")
    return read(spark, sf, "part").select(k, bibtex(F.concat(F.lit("k"), k), F.concat("p_name", F.lit(" & more _x_")), F.array(F.col("p_brand"), F.lit("B")), F.when(F.col("p_size") % 2 == 0, "J"), F.col("p_size") + 1990, F.when(k % 2 == 0, F.concat(F.lit("10.1000/P"), k))).alias("entry"))


@query("""WITH e AS (SELECT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linenumber = 1) SELECT DISTINCT 'p' || p AS subject, CASE WHEN p % 9 = 0 THEN 'relation' WHEN p % 5 = 0 THEN 'evidence_missing' END AS error FROM e WHERE p % 9 = 0 OR p % 5 = 0
UNION ALL SELECT DISTINCT 'p' || p, 'evidence_missing' FROM e WHERE p % 9 = 0 AND p % 5 = 0""")
def q_version_errors(spark, sf):
    from ..operators import versions

    l = read(spark, sf, "lineitem").where("l_linenumber = 1")
    p = F.col("l_partkey")
    rows = l.select(F.concat(F.lit("p"), p).alias("subject"), F.when(p % 9 == 0, "copy_of").otherwise("preprint_of").alias("relation"), F.concat(F.lit("s"), "l_suppkey").alias("object"), F.when(p % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("ev"))).alias("evidence_ids"), F.lit(False).alias("confirmed"))
    return versions.edge_errors(rows).select("subject", "error").distinct()
