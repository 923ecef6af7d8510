"""Paging, lookups and readers over archived answers."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions.validate import InvalidInput
from quillspark.sources import archive, lookups, paging, payloads


def pages(spark, *rows):
    return spark.createDataFrame([(r, p, c, json.dumps(b) if not isinstance(b, str) else b) for r, p, c, b in rows], "run string, page int, cursor string, body string")


def state(frame):
    return {r.run: (r.state, r.total_available, r.records_returned, r.pages, r.errors) for r in frame.collect()}


def epmc(total, cursor, *titles):
    return {"hitCount": total, "nextCursorMark": cursor, "resultList": {"result": [{"id": str(i), "title": t, "authorString": "A B, C D.", "isOpenAccess": "Y", "pubType": "x; y", "doi": "10.1/A"} if t else {"id": "0"} for i, t in enumerate(titles)]}}


def test_cursor_search(spark):
    p = pages(
        spark, ("all", 0, "*", epmc(3, "b", "T1", "T2")), ("all", 1, "b", epmc(3, "c", "T3")), ("all", 2, "c", epmc(3, "d", "T4")),
        ("stuck", 0, "*", epmc(9, "*", "T1")), ("empty", 0, "*", epmc(9, "b", "T1")), ("empty", 1, "b", epmc(9, "c")), ("odd", 0, "*", epmc(1, "b", "", "T1")),
        ("broken", 0, "*", epmc(9, "b", "T1")), ("broken", 1, "b", {"hitCount": 9}), ("short", 0, "*", epmc(9, "b", "T1")), ("nothing", 0, "*", epmc(0, None)), ("text", 0, "*", "no json"),
    )
    rows, run = paging.europe_pmc(p)
    assert state(run) == {
        "all": ("complete", 3, 3, 2, []), "stuck": ("partial", 9, 1, 1, ["cursor_stuck"]), "empty": ("partial", 9, 1, 2, ["empty_page"]), "odd": ("partial", 1, 1, 1, ["unusable_records"]),
        "broken": ("partial", 9, 1, 2, ["result_list_missing"]), "short": ("partial", 9, 1, 1, ["pages_missing"]), "nothing": ("complete", 0, 0, 1, []), "text": ("partial", 0, 0, 1, ["result_list_missing"]),
    }
    one = rows.where("run = 'all' and position = 1").first()
    assert (one.title, one.authors, one.types, one.access, one.doi) == ("T1", ["A B", "C D"], ["x", "y"], "open", "10.1/a")
    capped, run = paging.europe_pmc(p, 2)
    assert state(run)["all"][:3] == ("truncated", 3, 2)
    assert capped.where("run = 'all'").count() == 2


def test_work_search(spark):
    work = {"id": "https://openalex.org/W1", "title": None, "display_name": "Shown", "ids": {"pmid": "https://pubmed/77", "pmcid": "pmc12"}, "publication_year": 2001, "open_access": {"is_oa": True, "oa_url": "u"}, "is_retracted": True, "authorships": [{"author": {"display_name": "A"}}, {"author": None}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "referenced_works": ["https://openalex.org/W2", "x"]}
    rows, run = paging.search("openalex", pages(spark, ("r", 0, "*", {"meta": {"count": 1}, "results": [work, {"id": "W9"}]})))
    r = rows.first()
    assert (r.title, r.pmid, r.pmcid, r.year, r.access_url, r.flag, r.authors, r.abstract, r.references, r.record_id) == ("Shown", "77", "PMC12", 2001, "u", "flagged", ["A"], "a b a", ["W2"], "W1")
    assert state(run)["r"] == ("complete", 1, 1, 1, [])
    with pytest.raises(ValueError):
        paging.search("elsewhere", pages(spark, ("r", 0, "*", {})))


def test_ranked_search(spark):
    item = {"DOI": "10.1/X", "title": ["T"], "issued": {"date-parts": [[1999, 2]]}, "author": [{"family": "F", "given": "G"}, {}], "abstract": "<p>a</p>"}
    rows, run = paging.crossref(pages(spark, ("r", 0, None, {"message": {"total-results": 9, "items": [item]}}), ("r", 1, None, {"message": {"total-results": 9, "items": []}})), 2)
    assert (rows.first().authors, rows.first().year, rows.first().abstract) == (["F G"], 1999, "a")
    assert state(run)["r"] == ("partial", 9, 1, 2, ["empty_page"])
    for bad in (None, 10_001):
        with pytest.raises(InvalidInput):
            paging.request_size("crossref", bad, 100)
    assert paging.request_size("openalex", None, 500) == 200


def test_set_search(spark):
    sets = spark.createDataFrame([(r, json.dumps(b)) for r, b in (("ok", {"esearchresult": {"count": "2", "querykey": "1", "webenv": "w"}}), ("lost", {"esearchresult": {"count": "2", "querykey": "1"}}), ("none", {"esearchresult": {"count": "0", "querykey": "1", "webenv": "w"}}))], "run string, body string")
    summary = {"result": {"uids": ["5", "6"], "5": {"title": "T", "articleids": [{"idtype": "doi", "value": "10.1/Q"}], "authors": [{"name": "A"}], "pubtype": ["Retracted Publication"], "pubdate": "2003 Jan"}, "6": {"title": " "}}}
    rows, run = paging.pubmed(sets, pages(spark, ("ok", 0, None, summary)))
    r = rows.first()
    assert (rows.count(), r.pmid, r.doi, r.year, r.flag) == (1, "5", "10.1/q", 2003, "flagged")
    assert state(run) == {"ok": ("partial", 2, 1, 1, ["pages_missing", "unusable_records"]), "lost": ("partial", 2, 0, 0, ["history_missing"]), "none": ("complete", 0, 0, 0, [])}


def answers(spark, *rows):
    return spark.createDataFrame([(k, i, s, json.dumps(b) if not isinstance(b, str) else b) for i, (k, s, b) in enumerate(rows)], "key string, seq int, status int, body string")


def test_replay(spark):
    a = answers(spark, ("a", 500, "x"), ("a", 200, {"x": 1}), ("b", 404, "{}"), ("c", 200, "[1]"))
    got = {r.key: (r.json, r.error) for r in lookups.replay(spark.createDataFrame([(k,) for k in "abcd"], "key string"), a).collect()}
    assert got == {"a": ('{"x": 1}', None), "b": (None, "status 404"), "c": (None, "not a JSON object"), "d": (None, "not archived")}


def test_registry(spark):
    work = {"message": {"DOI": "10.1/A", "title": [" T "], "relation": {"is-retracted-by": [{"type": "x", "label": "y"}]}, "reference": [{"DOI": "10.2/b"}, {}, {"DOI": "10.2/B"}]}}
    w = lookups.registry_works(answers(spark, ("doi:10.1/a", 200, work)))
    assert (w.first().title, w.first().url) == ("T", "https://doi.org/10.1/a")
    assert tuple(lookups.reference_dois(w).first()) == ("10.1/a", ["10.2/b"], 3)
    item = lambda *dois: {"update-to": [{"DOI": d, "type": "retraction"} for d in dois]}
    notices, looked = lookups.update_notices(answers(spark, ("10.1/a", 200, {"message": {"total-results": 1, "items": [item("10.1/A", "10.9/z")]}}), ("10.1/b", 200, {"message": {"total-results": 2, "items": [item("10.1/b")]}}), ("10.1/c", 200, {"message": {"items": [item("10.9/z")]}}), ("10.1/d", 200, {}), ("10.1/e", 500, {})))
    assert [tuple(r)[:2] for r in notices.collect()] == [("10.1/a", "retraction")]
    assert {r.key: r.failure for r in looked.collect()} == {"10.1/a": None, "10.1/b": "truncated", "10.1/c": "item not bound", "10.1/d": "items missing", "10.1/e": "status 500"}


def test_works_and_links(spark):
    works = spark.createDataFrame([("W1", "10.1/a", "5", "T", ["W2", "W3"]), ("W2", None, "6", "U", [])], "record_id string, doi string, pmid string, title string, references array<string>")
    got = {r.identifier: (r.record_id, r.error) for r in lookups.resolve_works(spark.createDataFrame([("https://openalex.org/W1",), ("doi:10.1/A",), ("pmid:6",), ("7",), ("?",)], "identifier string"), works).collect()}
    assert got == {"https://openalex.org/W1": ("W1", None), "doi:10.1/A": ("W1", None), "pmid:6": ("W2", None), "7": (None, "not found"), "?": (None, "unsupported identifier")}
    assert {(r.src, r.dst) for r in lookups.work_edges(works).collect()} == {("W1", "W2"), ("W1", "W3")}
    box = lambda *ids: json.dumps({"hitCount": 4, "referenceList": {"reference": [{"source": "MED" if i else "PPR", "id": i} for i in ids]}})
    p = spark.createDataFrame([("5", 1, box("8", "")), ("5", 2, box("8", "9"))], "key string, page int, body string")
    n = lookups.neighbours(lookups.link_pages(p, "references"), 3).first()
    assert (n.src, n.dsts, n.total, n.without, n.truncated) == ("5", ["8"], 4, 1, True)
    with pytest.raises(ValueError):
        lookups.link_pages(p, "others")


def test_core_and_locations(spark):
    body = {"resultList": {"result": [{"id": "5", "pmid": "5", "title": "T", "pmcid": "PMC5", "doi": "10.1/c", "isOpenAccess": "Y", "abstractText": " a  b ", "license": "cc by"}]}}
    core = lookups.core_records(spark.createDataFrame([("5",), ("5",), ("x",)], "pmid string"), answers(spark, ("batch", 200, body)))
    records = spark.createDataFrame([("5", "", None, "unknown", None, None), ("6", "10.1/z", None, "unknown", None, "own")], "pmid string, doi string, pmcid string, access string, abstract string, license string")
    got = {r.pmid: (r.doi, r.pmcid, r.access, r.abstract, r.license) for r in lookups.enrich(records, core).collect()}
    assert got == {"5": ("10.1/c", "PMC5", "open", "a b", "cc by"), "6": ("10.1/z", None, "unknown", None, "own")}
    stores = [spark.createDataFrame(x, "key string, value string") for x in ([("a", "1")], [("a", "2"), ("b", "3")])]
    assert {tuple(r) for r in lookups.first_store(stores).collect()} == {("a", "1"), ("b", "3")}
    found, issues = lookups.open_locations(answers(spark, ("10.1/a", 200, {"best_oa_location": {"url_for_pdf": "", "url": "u", "license": "cc0"}}), ("10.1/b", 404, {}), ("10.1/c", 503, {}), ("10.1/d", 200, {"best_oa_location": None})))
    assert [r.url for r in found.collect()] == ["u"]
    assert [r.doi for r in issues.collect()] == ["10.1/c"]


DECLARED = '<!DOCTYPE PubmedArticleSet PUBLIC "-//NLM//DTD PubMedArticle, 1st January 2025//EN" "https://dtd.nlm.nih.gov/ncbi/pubmed/out/pubmed_250101.dtd">'


def article(pmid, *notices):
    return f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><CommentsCorrectionsList>{''.join(notices)}</CommentsCorrectionsList></MedlineCitation></PubmedArticle>"


def test_relations(spark):
    notice = '<CommentsCorrections RefType="RetractionIn"><RefSource>J. doi: 10.1234/Abc.</RefSource><PMID>6</PMID><Note> a  b </Note></CommentsCorrections>'
    listed = '<CommentsCorrections RefType="ErratumIn"><ArticleIdList><ArticleId IdType="pmc">x</ArticleId><ArticleId IdType="doi">10.1/L</ArticleId></ArticleIdList></CommentsCorrections>'
    xml = {"ok": DECLARED + f"<PubmedArticleSet>{article(5, notice, listed)}{article(9)}</PubmedArticleSet>", "two": f"<PubmedArticleSet>{article(5)}{article(5)}</PubmedArticleSet>", "other": f"<PubmedArticleSet>{article(7)}</PubmedArticleSet>", "entity": "<!ENTITY x><a/>", "type": '<!DOCTYPE PubmedArticleSet SYSTEM "x"><PubmedArticleSet/>', "error": "<PubmedArticleSet><ERROR>no</ERROR></PubmedArticleSet>"}
    rows, issues = payloads.pubmed_relations(spark.createDataFrame([(k, "5", v) for k, v in xml.items()], "request_id string, pmid string, body string"))
    assert {(r.ref_type, r.other_pmid, r.doi, r.note) for r in rows.collect()} == {("RetractionIn", "6", "10.1234/abc", "a b"), ("ErratumIn", None, "10.1/l", None)}
    assert {r.request_id: r.message for r in issues.collect()} == {"two": "not exactly one article", "other": "not exactly one article", "entity": "unsafe declaration", "type": "unsafe declaration", "error": "explicit error"}


def test_archived_pages(spark, tmp_path):
    files = []
    for run in ("a", "b"):
        f = tmp_path / f"{run}.jsonl"
        f.write_text("\n".join(json.dumps({"run": run, "page": i, "cursor": c, "body": epmc(2, n, f"T{i}")}) for i, (c, n) in enumerate((("*", "x"), ("x", "y")))) + ("\nbroken" if run == "b" else ""))
        files.append(str(f))
    archive.register(spark)
    rows, run = paging.europe_pmc(spark.read.format("archived_pages").option("paths", ",".join(files)).load())
    assert rows.count() == 4
    assert {k: v[0] for k, v in state(run).items() if k in "ab"} == {"a": "complete", "b": "complete"}


def test_loaders(spark, tmp_path):
    (tmp_path / "x.response").write_bytes(b"body")
    meta = {"request": {"method": "GET", "url": "https://a.org"}, "fetched_at": "t", "http_status": 200, "response": {"body_file": "x.response", "byte_length": 4, "sha256": "230d8358dc8e8890b4c58deeb62912ee2f20357ae92a5cc861b98e68fe31acb5"}}
    (tmp_path / "x.metadata.json").write_text(json.dumps(meta))
    (tmp_path / "y.metadata.json").write_text(json.dumps(meta | {"response": meta["response"] | {"body_file": "y.response"}}))
    assert {r.name: r.error for r in archive.raw_responses(spark, str(tmp_path)).collect()} == {"x.response": None, "y.response": "missing"}
    log = tmp_path / "l.jsonl"
    log.write_text("a\n\nb")
    assert [(r.line, r.value, r.ended) for r in archive.log_lines(spark, str(log)).orderBy("line").collect()] == [(1, "a", True), (2, "", True), (3, "b", False)]
    (tmp_path / "o.txt").write_text("[1]")
    assert archive.json_objects(spark, str(tmp_path / "o.txt")).first().error == "not an object"
    assert spark.range(1).select(archive.media_type(F.lit(" Text/XML; charset=x")).alias("m")).first().m == "text/xml"
