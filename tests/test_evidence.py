"""Verification, licences, status, claims, official sources, stores, access, release checks, references, reports, batches and expansion on small cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import validate
from quillspark.functions.validate import IntegrityError, InvalidInput
from quillspark.operators import access, claims, crossmark, licences, official, pdfrefs, release, reports, store, verify
from quillspark.plans import snowball
from quillspark.plans.rules import Rule
from quillspark.sources import archive
from quillspark.streaming import batch

A = "a" * 64
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
canonical = lambda o: json.dumps(o, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
RECORD = "rec string, title string, doi string, pmid string, sources array<string>, types array<string>, conflicts array<string>"
LOOKUP = "kind string, key string, failure string, retrieved_at string, response_sha256 string, url string"
WORK = "key string, doi string, title string, type string, subtype string, updates array<struct<type:string,label:string>>, relation map<string,array<struct<type:string,label:string>>>"


def test_arguments():
    assert validate.selector("3, 1,10-12") == [1, 3, 10, 11, 12]
    for bad in ("0", "5-1", "1-2000", "a", ""):
        with pytest.raises(InvalidInput):
            validate.selector(bad)
    for limit, size in ((0, 10), (10, 0), (-1, 1)):
        with pytest.raises(InvalidInput):
            validate.paging(limit, size)
    assert validate.paging(5, 100) == 5


def test_values(spark):
    col = lambda f, v, kind="string": spark.createDataFrame([(v,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o
    assert [col(validate.timestamp, t) for t in ("2025-01-02T03:04:05Z", "2025-01-02T03:04:05+02:00", "2025-01-02T03:04:05", "2025-13-02T03:04:05Z", None)] == [True, True, False, False, False]
    assert col(lambda c: validate.forbidden_keys(c), '{"a": [{"My-Password": 1, "b": "token: x"}]}') == ["My-Password"]
    assert col(lambda c: validate.forbidden_keys(c), "{") is None
    r = spark.createDataFrame([("failed", "not_matched"), ("failed", None), ("completed", None), ("partial", "not_matched"), ("odd", None)], "e string, m string")
    assert [x.o is None for x in r.select(validate.outcome_error(F.col("e"), F.col("m")).alias("o")).collect()] == [False, True, False, True, False]


def test_verification(spark):
    records = spark.createDataFrame([
        ("cross", "A fine title", "10.1/A", "5", ["pubmed"], [], []), ("conflict", "A fine title", "10.1/b", None, ["x"], [], []), ("alone", "T", "10.1/none", None, ["x"], [], []), ("nothing", "T", None, None, ["x"], [], []),
        ("mirror", "T", None, "7", ["europe_pmc"], ["Retracted Publication"], None), ("held", "A fine title", "10.1/a", None, ["x"], [], ["before"]), ("open", "A fine title", "10.1/c", None, ["x"], [], []),
    ], RECORD)
    works = spark.createDataFrame([("10.1/a", "10.1/A", "A Fine Title!", None, None, None, None), ("10.1/b", "10.1/zz", "Something else", None, None, None, None), ("10.1/c", "10.1/c", "A fine title", None, None, None, {"is corrected by": []})], WORK)
    notices = spark.createDataFrame([("10.1/a", "expression_of_concern", None)], "target string, type string, label string")
    relations = spark.createDataFrame([("5", "ErratumIn")], "pmid string, ref_type string")
    ok = lambda kind, key: (kind, key, None, "t", A, "u")
    lookups = spark.createDataFrame([ok("updates", "10.1/a"), ok("updates", "10.1/b"), ("updates", "10.1/c", None, "t", "short", "u"), ok("relations", "5"), ("relations", "7", "lost", None, None, None)], LOOKUP)
    out, issues = verify.verify(records, works, notices, relations, lookups)
    got = {r.rec: (r.verification, r.status, r.complete, r.ready) for r in out.collect()}
    assert got == {
        "cross": ("cross_source_verified", "expression_of_concern", True, False), "conflict": ("metadata_conflict", "unknown", True, False), "alone": ("unverified", "unknown", False, False), "nothing": ("unverified", "unknown", True, False),
        "mirror": ("authoritative_id_verified", "retracted", False, False), "held": ("metadata_conflict", "expression_of_concern", True, False), "open": ("cross_source_verified", "correction", False, False),
    }
    by = {r.rec: r for r in out.collect()}
    assert by["conflict"].conflicts == ["doi_mismatch", "title_mismatch"]
    assert by["cross"].signals == ["crossref:update-to.type:expression_of_concern"]
    assert by["mirror"].signals == ["pubmed:publication_type:retracted"]
    assert by["cross"].checked == ["crossref_reverse_updates", "pubmed_comments_corrections"]
    assert {(i.rec, i.source) for i in issues.collect()} == {("open", "crossref"), ("mirror", "pubmed")}


def test_ready_needs_everything(spark):
    record = spark.createDataFrame([("r", "T one two", "10.1/a", None, ["x"], [], [])], RECORD)
    work = spark.createDataFrame([("10.1/a", "10.1/a", "T one two", None, None, None, None)], WORK)
    none = spark.createDataFrame([], "target string, type string, label string"), spark.createDataFrame([], "pmid string, ref_type string")
    ok = spark.createDataFrame([("updates", "10.1/a", None, "t", A, "u")], LOOKUP)
    assert verify.verify(record, work, *none, ok)[0].first().ready is True
    assert verify.verify(record, work, *none, ok.where("false"))[0].first().ready is False


def test_fields(spark):
    seen = spark.createDataFrame([("r", "doi", "europe_pmc", "e1", "10.1/A"), ("r", "doi", "pubmed", "e2", "doi:10.1/a"), ("r", "title", "other", "e3", "B"), ("r", "title", "crossref", "e4", "A")], "rec string, field string, source string, evidence_id string, value string")
    got = {r.field: (r.selected.value, [a.value for a in r.alternatives], r.conflict) for r in verify.decide_fields(seen).collect()}
    assert got == {"doi": ("doi:10.1/a", ["10.1/A"], False), "title": ("A", ["B"], True)}


def test_record_semantics(spark):
    schema = "rec string, doi string, pmid string, evidence array<struct<evidence_id:string,source:string,record_id:string,doi:string,pmid:string,response_sha256:string>>, status_ids array<string>, complete boolean, ready boolean"
    good = ("e1", "crossref_status", "10.1/a", "https://doi.org/10.1/A", None, A)
    rows = spark.createDataFrame([("ok", "10.1/a", None, [good], ["e1"], True, True), ("lost", "10.1/a", None, [], ["e1"], True, False), ("other", "10.1/a", None, [("e1", "crossref_status", "10.1/b", "10.1/b", None, A)], ["e1"], True, False), ("open", None, "5", [good], [], False, True)], schema)
    got = {}
    for r in verify.semantic_errors(rows, spark.createDataFrame([(A,)], "response_sha256 string")).collect():
        got.setdefault(r.rec, set()).add(r.error)
    assert got == {"lost": {"status_evidence_unresolved", "needs_one_crossref_status"}, "other": {"crossref_status_target_differs"}, "open": {"ready_without_complete_check"}}
    assert verify.semantic_errors(rows.where("rec = 'ok'"), spark.createDataFrame([], "response_sha256 string")).first().error == "status_evidence_not_archived"


def test_licence_candidates(spark):
    cross = {"DOI": "10.1/a", "link": [{"URL": "u1", "content-version": "vor"}, {"URL": "u2"}, {"URL": "u3", "content-version": "am"}, {"URL": "u1", "content-version": "vor"}], "license": [{"URL": "l1", "content-version": "vor"}, {"URL": "l0"}]}
    pmc = {"pmcid": "PMC1", "license": [{"x": 1}, {"text": " cc by "}], "files": [{"href": "f", "version": "Accepted Manuscript"}, 7], "pdf_url": "p"}
    euro = {"id": "1", "license": "cc0", "fullTextUrlList": {"fullTextUrl": [{"url": "e", "license": {"url": "own"}}, {"url": " "}]}}
    rows = licences.discover(spark.createDataFrame([("c", "crossref", json.dumps(cross)), ("p", "pmc", json.dumps(pmc)), ("e", "europe_pmc", json.dumps(euro)), ("x", "pmc", "{")], "rec string, kind string, body string"))
    got = [(r.rec, r.position, r.url, r.license_text, r.version) for r in rows.orderBy("rec", "position").collect()]
    assert got == [("c", 1, "u1", "l1", "publishedVersion"), ("c", 2, "u2", "l0", None), ("c", 3, "u3", None, "acceptedVersion"), ("e", 1, "e", "own", None), ("p", 1, "f", "cc by", "acceptedVersion"), ("p", 2, "p", "cc by", None)]
    assert json.loads(rows.where("rec = 'c' and position = 2").first().raw_fragment_json) == {"record": "10.1/a", "link": {"URL": "u2"}, "license": {"URL": "l0"}}


def test_crossmark(spark):
    rows = []

    def say(target, route, kind, body, provider="p", status=200):
        rows.append((target, route, provider, kind, status, "u", "t", bytearray((body if isinstance(body, str) else json.dumps(body)).encode())))

    norm = lambda t, *types: {"target_doi": t, "updates": [{"target_doi": t, "type": k} for k in types]}
    work = lambda t, **more: {"message": {"DOI": t, **more}}
    ups = lambda t, *types: {"message": {"total-results": len(types), "items": [{"update-to": [{"DOI": t, "type": k}]} for k in types]}}
    say("10.1/a", "provider", crossmark.PROVIDER, norm("10.1/A", "Withdrawal", "erratum"))
    say("10.1/b", "provider", crossmark.PROVIDER, norm("10.1/x"))
    say("10.1/b", "fallback", crossmark.WORK, work("10.1/b", **{"update-policy": "x", "relation": {"is-corrected-by": ["1"], "is-retracted-by": []}}), "c")
    say("10.1/b", "fallback", crossmark.UPDATES, ups("10.1/b"), "c")
    say("10.1/c", "fallback", crossmark.WORK, work("10.1/c"), "c")
    say("10.1/d", "fallback", crossmark.WORK, work("10.1/d"), "c")
    say("10.1/d", "fallback", crossmark.UPDATES, {"message": {"total-results": 3, "items": []}}, "c")
    say("10.1/e", "provider", crossmark.PROVIDER, "[]", status=503)
    df = spark.createDataFrame(rows, "target string, route string, provider string, kind string, status_code int, url string, retrieved_at string, body binary")
    targets = spark.createDataFrame([(f"10.1/{c}",) for c in "abcdef"] + [(None,)], "target string")
    got = {r.target: (r.status, r.complete, r.route, r.fallback_used, r.declared, r.errors) for r in crossmark.assess(targets, df).collect()}
    assert got == {
        "10.1/a": ("retracted", True, "configured_provider", False, None, []), "10.1/b": ("correction", True, "crossref_public_rest_fallback", True, True, ["provider: target"]), "10.1/c": ("unknown", False, "none", False, None, ["fallback: kinds"]),
        "10.1/d": ("unknown", False, "none", False, None, ["fallback: incomplete"]), "10.1/e": ("unknown", False, "none", False, None, ["provider: status"]), "10.1/f": ("unknown", False, "none", False, None, ["no_route"]), None: ("unknown", False, "none", False, None, ["invalid_doi", "no_route"]),
    }


def test_anchors(spark):
    text = "One two.\n\nThree two.\n \nFour"
    cases = {("quote", "Three"): ("located", "Three"), ("quote", "two"): ("ambiguous", None), ("quote", "x"): ("not_found", None), ("paragraph", "1-2"): ("located", "One two.\n\nThree two."), ("paragraph", "3-4"): ("out_of_bounds", None), ("paragraph", "2-1"): ("invalid_anchor", None), ("paragraph", "0"): ("invalid_anchor", None), ("page", "2"): ("located", "p2"), ("section", "S"): ("located", "body"), ("section", "Z"): ("not_found", None), ("line", "1"): ("invalid_anchor", None), ("quote", ""): ("invalid_anchor", None)}
    df = spark.createDataFrame([(k, v, text, ["p1", "p2"], {"S": "body"}) for k, v in cases], "k string, v string, t string, p array<string>, s map<string,string>")
    got = {(r.k, r.v): (r.a.status, r.a.excerpt) for r in df.select("k", "v", claims.locate(F.col("k"), F.col("v"), F.col("t"), F.col("p"), F.col("s")).alias("a")).collect()}
    assert got == cases
    assert df.where("k = 'page'").select(claims.locate(F.col("k"), F.col("v"), F.col("t"))["status"].alias("s")).first().s == "invalid_anchor"


JATS = '<article xmlns="http://jats.nlm.nih.gov"><front><article-meta><title-group><article-title>T <i>x</i></article-title></title-group></article-meta></front><body><p> B </p></body></article>'


def _event(previous, **more):
    e = {"event_type": claims.ATTESTED, "actor_type": "claimed_human", "attestation_method": "unverified_cli_claim", "identity_verified": False, "previous_event_hash": previous, **more}
    return e | {"event_hash": sha(canonical(e))}


def test_logs_and_bindings(spark):
    material = b"A quote here."
    first = _event("0" * 64, material_sha256=sha(material))
    second = _event(first["event_hash"], material_sha256=sha(b"z"))
    third = _event(second["event_hash"], event_type=claims.RESCINDED, target_event_hash=second["event_hash"])
    logs = {"ok": [first, second, third], "altered": [first, second | {"material_sha256": A}], "cut": [second], "machine": [_event("0" * 64, actor_type="bot")], "text": [first, "{", second], "blank": [first, ""], "list": ["[1]"], "kind": [_event("0" * 64, event_type="X")], "claim": [_event("0" * 64, identity_verified=True)]}
    lines = spark.createDataFrame([(k, i + 1, e if isinstance(e, str) else canonical(e)) for k, es in logs.items() for i, e in enumerate(es)], "log string, line int, value string")
    got = {r.log: (r.valid, r.events, r.failed_line, r.failure) for r in claims.verify_logs(lines).collect()}
    assert got == {
        "ok": (True, 3, None, None), "altered": (False, 1, 2, "event_hash"), "cut": (False, 0, 1, "previous_hash"), "machine": (False, 0, 1, "actor_type"), "text": (False, 1, 2, "invalid_json"), "blank": (False, 1, 2, "blank_line"),
        "list": (False, 0, 1, "not_an_object"), "kind": (False, 0, 1, "event_type"), "claim": (False, 0, 1, "identity_claim"),
    }
    attested = claims.attestations(lines)
    assert {(r.log, r.event_hash): r.standing for r in attested.collect()} == {("ok", first["event_hash"]): "attested", ("ok", second["event_hash"]): "rescinded"}

    base = {"claim_id": "c1", "claim_text": "x", "material": bytearray(material), "content_type": "text/plain", "expected_sha256": sha(material), "evidence_id": "ev-" + "0" * 20, "anchor_kind": "quote", "anchor_value": "quote", "text": "A quote here.", "support": "SUPPORTED", "expected_excerpt_sha256": None, "attestation_log": None, "attestation_hash": None}
    changes = {
        "good": {}, "read": {"attestation_log": "ok", "attestation_hash": first["event_hash"]}, "attestation_rescinded": {"attestation_log": "ok", "attestation_hash": second["event_hash"]}, "attestation_unknown": {"attestation_log": "altered", "attestation_hash": first["event_hash"]},
        "attestation_incomplete": {"attestation_log": "ok"}, "claim_id": {"claim_id": "-"}, "material_sha256": {"expected_sha256": A}, "text": {"text": "other"}, "anchor_kind": {"anchor_kind": "page"}, "locator_not_found": {"anchor_value": "nowhere"}, "excerpt_sha256": {"expected_excerpt_sha256": A}, "support": {"support": "YES"},
        "material_content_type": {"content_type": "application/pdf"}, "article": {"material": bytearray(JATS.encode()), "expected_sha256": sha(JATS), "content_type": "application/xml", "text": "T\nx\nB", "anchor_value": "B"}, "material_structure": {"material": bytearray(b"<article/>"), "expected_sha256": sha("<article/>"), "content_type": "text/xml"},
    }
    schema = ", ".join(f"{k} {'binary' if k == 'material' else 'string'}" for k in base) + ", name string"
    rows = spark.createDataFrame([(*(base | c).values(), n) for n, c in changes.items()], schema)
    for name in changes:
        r = claims.bind(rows.where(F.col("name") == name), attested).first()
        if name in ("good", "read", "article"):
            assert (r.rejected, r.support, r.identity_verified, r.human_review) == (None, "AMBIGUOUS", False, "SELF_ATTESTED" if name == "read" else "NOT_ATTESTED")
        else:
            assert r.rejected == name


def test_articles(spark):
    bad = {"declarations": "<!DOCTYPE a><article/>", "not_well_formed": "<a", "container": "<html/>", "namespace": '<article xmlns="http://else.org"/>', "structure": "<article><body/></article>"}
    df = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in bad.items()], "k string, v binary")
    assert {r.k: r.x.error for r in df.select("k", claims.article_text("v").alias("x")).collect()} == {k: k for k in bad}


def test_refusals_and_packets(spark):
    r = spark.createDataFrame([("human", "anonymous_reviewer", "I have read it all", True), ("bot", "anonymous_a", "I have read it all", True), ("human", "Dr Who", "I have read it all", True), ("human", "anonymous_a", " a  b ", True), ("human", "anonymous_a", "I have read it all", None)], "a string, r string, s string, e boolean")
    assert [x.o for x in r.select(validate.actor_error(F.col("a"), F.col("r"), F.col("s"), 10, F.col("e")).alias("o")).collect()] == [None, "actor_type", "reviewer_role", "statement", "explicit_command"]
    rows = spark.createDataFrame([(bytearray(b"m"), "anonymous_reviewer", "I have  read all of this text.", "2025-01-02T03:04:05Z"), (bytearray(b"m"), "me", "I have read all of this text.", "t")], "material binary, reviewer_role string, confirmation_statement string, issued_at string")
    packets = [x.packet for x in claims.review_packets(rows).collect()]
    assert packets[1] is None
    p = json.loads(packets[0])
    digest = p.pop("packet_sha256")
    assert digest == sha(canonical(p))
    altered = {"packet_sha256": p | {"packet_sha256": A}, "keys": p, "version": p | {"packet_sha256": digest, "schema_version": 2}, "issued_at": p | {"packet_sha256": digest, "issued_at": "soon"}, "identity_claim": p | {"packet_sha256": digest, "identity_claim": "me"}}
    df = spark.createDataFrame([("good", packets[0])] + [(k, canonical(v)) for k, v in altered.items()], "k string, p string")
    assert {x.k: x.e for x in df.select("k", claims.packet_error(F.col("p")).alias("e")).collect()} == {"good": None, **{k: k for k in altered}}
    assert df.where("k = 'good'").select(claims.packet_error(F.col("p"), F.lit(b"other")).alias("e")).first().e == "material"


def test_official(spark, tmp_path):
    urls = {"https://Sub.Example.org/a/b?x=1#f": ("https://sub.example.org/a/b?x=1", "sub.example.org", "/a/b"), "http://example.org": None, "https://u@example.org/": None, "https://example.org:8443/": None, "https://localhost/": None, "https://10.0.0.1/": None, "https://example.org/a/../b": None, "https://example.org/%252e": None, "https://example.org/?token=1": None, "https://bücher.example/": ("https://xn--bcher-kva.example/", "xn--bcher-kva.example", "/")}
    got = {r.u: tuple(r.n) for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", official.normalize_https("u").alias("n")).collect()}
    assert got == {u: v or (None, None, None) for u, v in urls.items()}
    rule = "organization_id string, organization_name string, rules array<struct<hostname:string,path_prefixes:array<string>,include_subdomains:boolean>>, registrar_role string, evidence_url string, evidence binary, observed_at string"
    regs = spark.createDataFrame([("Org", "An Org", [("example.org", ["/b", "/a/"], True), ("other.org", ["/"], False)], "role", "https://example.org/e", bytearray(b"x"), "2025-01-02T03:04:05Z"), ("bad org", "x", [], "r", "u", None, "t")], rule)
    assert {r.organization_id: r.error for r in official.register(regs).collect()} == {"Org": None, "bad org": "organization_id"}
    asked = spark.createDataFrame([("ORG", "https://www.example.org/a/x", "T"), ("org", "https://example.org/ab", "T"), ("org", "https://sub.other.org/", "T"), ("org", "https://other.org/z", " "), ("none", "https://other.org/", "T"), ("org", "ftp://x", "T")], "organization_id string, url string, title string")
    rows = official.propose(asked, regs).collect()
    assert sorted((r.url or "", r.error or "", r.prefix or "") for r in rows) == sorted([("https://www.example.org/a/x", "", "/a"), ("https://example.org/ab", "outside", ""), ("https://sub.other.org/", "outside", ""), ("https://other.org/z", "title", "/"), ("https://other.org/", "not_registered", ""), ("", "url", "")])
    record = {"organization_id": "org", "registration_evidence_byte_length": 1, "registration_evidence_sha256": sha(b"x")}
    bundle = {"schema_version": 1, "artifact_type": "manual_official_source_registration_evidence", "evidence_encoding": "base64", "registration": record, "registration_sha256": sha(canonical(record)), "evidence_bytes": "eA=="}
    for name, change in {"good": {}, "contract": {"schema_version": 2}, "registration_sha256": {"registration_sha256": A}, "evidence": {"evidence_bytes": "eQ=="}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(bundle | change))
    assert {r.file.rsplit("/", 1)[1][:-5]: r.error for r in official.load_bundles(spark, str(tmp_path)).collect()} == {"good": None, "contract": "contract", "registration_sha256": "registration_sha256", "evidence": "evidence"}


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.create(spark, path)
    store.create(spark, path)
    schema = "method string, url string, accept string, status int, fetched_at string, source string, etag string, last_modified string, body binary"
    rows = spark.createDataFrame([("get", "https://a.org/x?token=1", "application/json", 200, t, "s", None, None, bytearray(b)) for t, b in (("1", b"old"), ("2", b"new"))], schema)
    store.put(rows, path)
    store.put(rows.limit(1), path)
    assert [store.table(spark, path, t).count() for t in ("requests", "blobs", "responses")] == [1, 2, 3]
    wanted = spark.createDataFrame([("GET", "https://A.org/x", "application/json"), ("GET", "https://b.org/", "*/*")], "method string, url string, accept string")
    got = {r.url: (r.error, r.body) for r in store.get(wanted, path).collect()}
    assert got["https://b.org/"][0] == "not cached"
    assert got["https://A.org/x"][0] is None
    assert [r.url for r in store.missing(wanted, path).collect()] == ["https://b.org/"]
    assert store.integrity(spark, path).count() == 0
    spark.createDataFrame([(sha("q"), bytearray(b"z"), 1)], store.SCHEMAS["blobs"]).write.mode("append").parquet(f"{path}/blobs")
    assert [r.kind for r in store.integrity(spark, path).collect()] == ["body"]
    store.log_attempts(spark.createDataFrame([("t1", "k", "now", "ok", None)], store.SCHEMAS["attempts"]), path)
    store.log_checkpoints(spark.createDataFrame([("t1", 2, "b", "n"), ("t1", 1, "a", "n"), ("t2", 1, "c", "n")], store.SCHEMAS["checkpoints"]), path)
    assert [r.state for r in store.checkpoints(spark, path, "t1").collect()] == ["a", "b"]
    spark.createDataFrame([(9,)], "version int").write.mode("overwrite").parquet(f"{path}/version")
    with pytest.raises(IntegrityError):
        store.table(spark, path, "requests")


def test_archive(spark, tmp_path):
    rows = spark.createDataFrame([("get", "https://u@a.org/?email=x&q=1", {"Accept": "a", "Authorization": "b", "X-Api-Key": "c"}, 200, "2025-01-02T03:04:05.6+00:00", bytearray(b"x"))] * 2, "method string, url string, headers map<string,string>, status int, fetched_at string, body binary")
    for _ in range(2):
        store.archive(rows, str(tmp_path / "a"))
    r = spark.read.parquet(str(tmp_path / "a")).collect()
    assert [(x.url, x.headers, x.byte_length) for x in r] == [("https://a.org/?q=1", {"Accept": "a"}, 1)]
    assert r[0].name.startswith("2025-01-02T03-04-05")
    ev = spark.createDataFrame([("e", bytearray(b"x"))], "evidence string, body binary")
    store.save_evidence(ev, str(tmp_path / "e"))
    with pytest.raises(Exception, match="(?i)exist"):
        store.save_evidence(ev, str(tmp_path / "e"))


PROFILE = {"institution": " U ", "webvpn_portal": "https://vpn.u.edu/", "platforms": [{"name": "One", "entry_url": "https://l/1", "doi_prefixes": ["10.1/"], "hosts": ["one.org"]}, {"name": "Two", "entry_url": "https://l/2", "doi_prefixes": ["10.2", "10.1/x"], "hosts": ["Two.org"]}]}


def test_access(spark, tmp_path):
    profile = access.parse_profile(PROFILE)
    for bad in ({}, {"institution": "x", "Pass_Word": 1, "user-name": 2, "api-key": 1}, {"institution": "x", "platforms": [{}]}, {"institution": "x", "webvpn_portal": "https://u:p@x"}, {"institution": "x", "a": [{"session_id": 1}]}, []):
        with pytest.raises(InvalidInput):
            access.parse_profile(bad)
    rows = spark.createDataFrame([(1, "A <b>", "10.2/q", "5", None), (2, "B", "10.1/x/y", None, None), (3, "C", None, None, "https://www.two.org/p"), (4, "D", "10.10/a", None, None), (5, "E", "", None, None), (6, "F", "10.2/z", None, "https://one.org/")], "seq int, title string, doi string, pmid string, landing_url string")
    planned = access.plan(rows, profile)
    assert {r.seq: (r.platform, r.route) for r in planned.collect()} == {1: ("Two", "federated_login"), 2: ("One", "federated_login"), 3: ("Two", "federated_login"), 4: ("", "webvpn_then_doi"), 5: ("", "webvpn_then_doi"), 6: ("One", "federated_login")}
    assert [(r.name, r.entry_url) for r in access.login_pages(planned).orderBy("first_seq").collect()] == [("Two", "https://l/2"), ("One", "https://l/1"), ("WebVPN", "https://vpn.u.edu/")]
    assert {r.route: r["count"] for r in access.route_counts(planned).collect()} == {"federated_login": 4, "webvpn_then_doi": 2}
    assert access.plan(rows, None).select("route").distinct().collect()[0].route == "no_profile"
    assert {r.route for r in access.plan(rows, profile | {"webvpn_portal": None}).collect()} == {"federated_login", "doi_only"}
    access.write_checklist(planned, str(tmp_path / "t"))
    assert {r.title for r in access.read_needs(spark, str(tmp_path / "t")).collect()} == {"A <b>", "B", "C", "D", "E", "F"}
    items = [r.value for r in access.html_rows(planned).orderBy("seq").collect()]
    assert "A &lt;b&gt;" in access.html_page(items, "U")
    (tmp_path / "p.json").write_text(json.dumps(PROFILE))
    assert access.load_profile(spark, str(tmp_path / "p.json"))["institution"] == "U"
    assert access.load_profile(spark, None) is None
    assert access.interactive(planned).count() == 6


def test_schema_errors(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False, "$defs": {"id": {"type": "string", "pattern": "^x", "minLength": 2}},
        "properties": {"a": {"$ref": "#/$defs/id"}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "l": {"type": "array", "items": {"$ref": "#/$defs/id"}, "minItems": 1, "maxItems": 2, "uniqueItems": True}, "k": {"enum": ["p", 1, None]}, "c": {"const": True}, "t": {"format": "date-time"}, "m": {"type": "object", "additionalProperties": {"type": "boolean"}, "minProperties": 1}},
        "if": {"properties": {"k": {"const": "p"}}, "required": ["k"]}, "then": {"required": ["n"]}, "else": {"properties": {"c": {"type": "boolean"}}}, "allOf": [{"maxProperties": 4}],
    }
    cases = {
        '{"a":"xy"}': [], "[]": ["$: type"], "{": ["unreadable"], "{}": ["$: required a"], '{"a":"x"}': ["$.a: minLength"], '{"a":"yy"}': ["$.a: pattern"], '{"a":"xy","z":1}': ["$: additionalProperties"], '{"a":"xy","n":null}': [], '{"a":"xy","n":1.5}': ["$.n: type"], '{"a":"xy","n":0}': ["$.n: minimum"], '{"a":"xy","n":10}': ["$.n: maximum"],
        '{"a":"xy","l":[]}': ["$.l: minItems"], '{"a":"xy","l":["xy","xy"]}': ["$.l: uniqueItems"], '{"a":"xy","l":["xy","q1"]}': ["$.l[]: pattern"], '{"a":"xy","k":null}': [], '{"a":"xy","k":2}': ["$.k: enum"], '{"a":"xy","k":"p"}': ["$: required n"], '{"a":"xy","k":"p","n":2}': [], '{"a":"xy","c":false}': ["$.c: const"],
        '{"a":"xy","t":"2025-01-02T03:04:05Z"}': [], '{"a":"xy","t":"soon"}': ["$.t: date-time"], '{"a":"xy","m":{"q":1}}': ["$.m.*: type"], '{"a":"xy","m":{}}': ["$.m: minProperties"], '{"a":"xy","n":1,"k":1,"c":true,"t":"2025-01-02"}': ["$: maxProperties"],
    }
    got = {r.b: r.errors for r in release.validate(spark.createDataFrame([(c,) for c in cases], "b string"), "b", schema).collect()}
    assert got == cases
    with pytest.raises(InvalidInput):
        release.schema_errors(F.lit(None), {"$ref": "#"} | {"$ref": "other.json"})


def _manifest():
    counts = dict(zip(release._COUNTS, (3, 2, 4, 2, 1, 1, 1, 0), strict=True))
    return {"source_pdf": {"name": "a.pdf", "page_count": 1}, "derivation": {"page_text_sha256": [A]}, "lookup_policy": {"lookup_enabled": True, "transport_mode": "network", "sources": ["s"], "selected_reference_numbers": [1, 2], "checkpoint_sha256": A, "cache_enabled": True}, "lookup_batch": {"batch_status": "partial", "selected_count": 2, "attempted_this_run": 2, "completed_count": 1, "partial_count": 1, "failed_count": 0, "pending_count": 0}, "summary": counts, "output_sha256": {"reference_results.jsonl": A, "citation_map.json": A, "report.md": A, "batch_checkpoint.jsonl": A}}


def test_release(spark):
    changed = {"good": lambda m: None, "source name has a path": lambda m: m["source_pdf"].update(name="a/b"), "page digests": lambda m: m["source_pdf"].update(page_count=2), "outputs missing": lambda m: m["output_sha256"].pop("report.md"), "cited exceed references": lambda m: m["summary"].update(cited_reference_count=9), "checkpoint digest": lambda m: m["lookup_policy"].update(checkpoint_sha256=None), "batch status": lambda m: m["lookup_batch"].update(batch_status="completed"), "lookup without source": lambda m: m["lookup_policy"].update(sources=[]), "section missing": lambda m: m.pop("derivation")}
    rows = []
    for name, change in changed.items():
        m = _manifest()
        change(m)
        rows.append((name, json.dumps(m)))
    errors = release.audit_manifest_errors(spark.createDataFrame(rows, "name string, body string"))
    assert {(r.name, r.error) for r in errors.collect()} == {(k, k) for k in changed if k != "good"}
    meta = {"clean": {"request": {"url": "https://a.org/?q=1", "headers": {"Accept": "x"}}}, "bad": {"request": {"url": "https://a.org/?Token=1", "headers": {"X-Key": "x"}}, "Cookie": 1}, "none": {}}
    leaks = release.redaction_errors(spark.createDataFrame([(k, json.dumps(v)) for k, v in meta.items()], "name string, body string"))
    assert {(r.name, r.error) for r in leaks.collect()} == {("bad", "member cookie"), ("bad", "header x-key"), ("bad", "parameter token"), ("none", "address missing")}
    cases = release.synthetic_cases(spark)
    assert (cases.count(), release.case_errors(cases).count()) == (240, 0)
    assert {r.error for r in release.case_errors(cases.where("category = 'retraction'").withColumn("human_adjudicated", F.lit(True)).withColumn("case_id", F.lit("x"))).collect()} == {"too_few", "too_narrow", "human_adjudicated", "id_repeated"}
    metrics = spark.createDataFrame([(5, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0), (5, 0, 0, 1, 0, 0), (5, 0, 0, 0, None, 0)], "cases int, missing int, unexpected int, mismatches int, false_positives int, false_negatives int")
    assert [r.g for r in metrics.select(release.gate(metrics).alias("g")).collect()] == [True, False, False, False]
    files = spark.createDataFrame([("a", 'version = "1.2"'), ("b", "v1.2"), ("c", "v1.3"), ("d", "")], "name string, value string")
    versions = release.version_errors(files, {"a": r'version = "([0-9.]+)"', "b": "v([0-9.]+)", "c": "v([0-9.]+)", "d": "v([0-9.]+)"})
    assert {(r.name, r.error) for r in versions.collect()} == {("c", "version differs"), ("d", "version missing")}
    assert release.release_errors(manifests=errors, archive=leaks).where("check = 'archive'").count() == 4


def test_cases_file(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps([{"case_id": "1"}, {"case_id": "2"}]))
    assert release.load_cases(spark, str(f)).count() == 2
    f.write_text(json.dumps([{"case_id": "1"}, {"case_id": "1"}]))
    with pytest.raises(InvalidInput):
        release.load_cases(spark, str(f))


PAGES = [(0, "Contents\nReferences\n"), (1, "Text cites [1-2] and [9]."), (2, "More text [2].\nReferences\n[1] Smith J. A title of some length. J Test. 2001;1:2.\nSecond line"), (3, "goes on.\n[2] Doe A. Another title that is different. J Other. 1999;3:4. doi: 10.1234/x.")]


def test_document_references(spark):
    pages = spark.createDataFrame([("d", p, t) for p, t in PAGES] + [("none", 1, "No list here [1].")], "doc string, page int, text string")
    assert [tuple(r) for r in pdfrefs.reference_start(pages).collect()] == [("d", 2, 25)]
    refs = pdfrefs.references(pages)
    got = {r.number: (r.page, r.raw) for r in refs.collect()}
    assert got == {1: (2, "Smith J. A title of some length. J Test. 2001;1:2. Second line goes on."), 2: (3, "Doe A. Another title that is different. J Other. 1999;3:4. doi: 10.1234/x.")}
    cited = pdfrefs.citations(pages)
    assert sorted((r.page, r.number) for r in cited.collect()) == [(1, 1), (1, 2), (1, 9), (2, 2)]
    assert [(r.number, r.kind) for r in pdfrefs.citation_errors(refs, cited).collect()] == [(9, "dangling")]
    looked = spark.createDataFrame([("d", 1, "completed", "matched_high_confidence")], "doc string, number int, execution_status string, best_decision string")
    s = pdfrefs.summary(refs, cited, looked).first()
    assert (s.reference_count, s.cited_reference_count, s.citation_occurrence_count, s.lookup_attempted_count, s.high_confidence_match_count, s.dangling_numbers, s.uncited_numbers) == (2, 2, 4, 1, 1, [9], [])
    rows = {r.number: r.lookup.execution_status for r in pdfrefs.result_rows(refs, cited, looked).collect()}
    assert rows == {1: "completed", 2: "pending"}


def test_candidates_of_a_frequent_key_are_those_of_all_pairs(spark, monkeypatch):
    """Titles that share runs of words, with equal ones, missing parts and DOIs: in groups of any size the best are those of every pair scored; of 40,000 pairs few titles are compared."""
    import difflib
    import random

    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    rows = [(i, pick("A study of ", "A study on ", "Of ") + pick("cold rings", "old rings", "old bolts in use") + pick("", f" {rng.randrange(40)}"), pick("Smith J", "Doe", "", None), pick(1999, 2001, None), pick("J Test", "J Tests", "Acta", "--", "", None), pick("10.1/a", f"10.1/{i}", None, None)) for i in range(160)]
    fields = "title string, author string, year int, journal string, doi string"
    refs, pubs = spark.createDataFrame(rows[:60], f"ref long, {fields}"), spark.createDataFrame(rows[50:], f"pub long, {fields}")
    score_all = lambda: sorted((r.ref, r.place, r.pub, r.score, r.decision) for r in pdfrefs.candidates(refs, pubs, 3).collect())
    monkeypatch.setattr(pdfrefs, "PAIRS", 10**9)
    want = score_all()
    for n_refs, n_pubs in ((1000, 30_000), (7, 5)):
        monkeypatch.setattr(pdfrefs, "PAIRS", 0)
        monkeypatch.setattr(pdfrefs, "REFS", n_refs)
        monkeypatch.setattr(pdfrefs, "PUBS", n_pubs)
        assert score_all() == want
    assert len({r[0] for r in want}) == 60
    calls = []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(pdfrefs.difflib, "SequenceMatcher", Counted)
    import pandas as pd

    many = pd.DataFrame({"ref": range(200), "k": "t:ring study number", "norm": [f"large ring study number {i} of small" for i in range(200)], "author": "smith", "year": [str(1990 + i % 50) for i in range(200)], "journal": "=j"})
    found = pdfrefs._best_of_group(3)(many, many.rename(columns={"ref": "pub"}))
    assert len(found) == 600
    assert set(zip(range(200), range(200), strict=True)) <= set(zip(found["ref"], found["pub"], strict=True))
    assert len(calls) < 40_000 / 20


def test_candidates_compare_few_titles_and_journals_where_all_differ(monkeypatch):
    """90,000 pairs of one key, each with its own title, year and journal: the best are those of all pairs, and few texts are compared one by one."""
    import difflib

    import numpy as np
    import pandas as pd

    n, ratio = 300, difflib.SequenceMatcher
    t = pd.DataFrame({"ref": range(n), "k": "t:ring study number", "norm": [f"large ring study number {i * 7919 % 10007} of small" for i in range(n)], "author": "smith", "year": [str(1700 + i % 150) for i in range(n)], "journal": [f"=brand {i * 31 % 1009}" for i in range(n)]})
    calls = []

    class Counted(ratio):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(pdfrefs.difflib, "SequenceMatcher", Counted)
    found = pdfrefs._best_of_group(3)(t, t.rename(columns={"ref": "pub"}))
    assert len(calls) < n * n / 20
    got = found.groupby("ref")["pub"].agg(set).to_dict()
    assert len(got) == n
    w = pdfrefs.WEIGHTS
    for i in range(0, n, 20):
        s = [round(w["title"] * ratio(None, t.norm[i], t.norm[j]).ratio() + w["author"] + w["year"] * (t.year[i] == t.year[j]) + w["journal"] * ratio(None, t.journal[i][1:], t.journal[j][1:]).ratio(), 6) for j in range(n)]
        assert got[i] == set(np.lexsort((range(n), [-v for v in s]))[:3])


def test_candidates_meet_others_of_a_key_only_where_these_may_be_among_the_best(spark, monkeypatch):
    """Of a key with several groups, references with author and year whose best agree in both are done; the others are searched in full. The rows are those of all pairs."""
    from quillspark.plans import tables

    rows = [(i, f"Cold rings study number {i} of small", "Smith J" if i % 40 else None, 1990 + i % 4 if i < 90 else 2020 + i, "J Test", None) for i in range(100)]
    fields = "title string, author string, year int, journal string, doi string"
    refs, pubs = spark.createDataFrame(rows, f"ref long, {fields}"), spark.createDataFrame(rows, f"pub long, {fields}")
    sizes, plain = {}, tables.saved

    def saved(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(tables, "saved", saved)
    found = lambda: sorted((r.ref, r.place, r.pub, r.score) for r in pdfrefs.candidates(refs, pubs, 3).collect())
    monkeypatch.setattr(pdfrefs, "PAIRS", 10**9)
    want = found()
    monkeypatch.setattr(pdfrefs, "PAIRS", 0)
    monkeypatch.setattr(pdfrefs, "REFS", 30)
    monkeypatch.setattr(pdfrefs, "PUBS", 25)
    assert found() == want and len(want) == 300
    assert sizes["large"] == 100  # of all keys, as these have no pair that "rings study number" has not
    assert sizes["open"] == 13


def test_ratios_are_those_of_difflib():
    import difflib
    import random

    from quillspark.functions.text import ratios

    rng = random.Random(3)
    text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    a, b = [], []
    for _ in range(1500):
        letters, most = rng.choice(["ab", "abc ", "0123456789", "abcdefgh "]), rng.choice([3, 12, 50, 190, 260])
        x = text(most)
        a.append(x)
        b.append(rng.choice([x, text(most), x[: len(x) // 2] + text(5) + x[len(x) // 2 :]]))
    assert ratios(a, b).tolist() == [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert ratios([], []).tolist() == []


def test_reference_candidates(spark):
    fields = "title string, author string, year int, journal string, doi string"
    refs = spark.createDataFrame([(1, "A title of some length", "Smith", 2001, "J Test", None), (2, "Quite another thing", "Doe", 1999, None, "10.1/q"), (3, "Nothing like it", None, None, None, None)], f"ref int, {fields}")
    pubs = spark.createDataFrame([(10, "A Title of Some Length.", "Smith J", 2001, "J Test", "10.1/a"), (11, "A title of some other kind", "X", 2001, None, None), (12, "Words", "Doe", 1999, None, "10.1/Q")], f"pub int, {fields}")
    got = {(r.ref, r.pub): r.decision for r in pdfrefs.candidates(refs, pubs).collect()}
    assert got == {(1, 10): "matched_high_confidence", (1, 11): "not_matched", (2, 12): "identifier_metadata_conflict"}
    refs = refs.withColumn("raw", F.lit("raw"))
    planned = [(r.step, r.query) for r in pdfrefs.queries(refs).where("ref = 1").orderBy("step").collect()]
    assert planned == [(1, "A title of some length[Title]"), (2, "Smith[Author] AND A title of some length[Title] AND 2001[dp]"), (4, 'TITLE:"A title of some length"')]
    asked = []

    def search(q):
        rows = q.collect()
        asked.append((rows[0].step if rows else None, sorted(r.ref for r in rows)))
        hits = q.where("(step = 1 and ref = 1) or (step = 4 and ref = 2)").select("ref").join(pubs.withColumn("r", F.when(F.col("pub") == 10, 1).when(F.col("pub") == 12, 2)), F.col("ref") == F.col("r")).drop("r")
        return hits, q.where("ref <> 3").select("ref", F.lit("complete").alias("state"))

    best, status = pdfrefs.lookup(refs, search)
    assert asked == [(1, [1, 2, 3]), (2, [2]), (None, []), (4, [2, 3])]
    assert {r.ref: (r.execution_status, r.search_complete, r.identity_resolved) for r in status.collect()} == {1: ("completed", False, True), 2: ("completed", True, False), 3: ("failed", False, False)}


def test_reports(spark, tmp_path):
    assert reports.run_folder("/r/", "2025-01-02T03:04:05.1+00:00", "a  b/c") == "/r/2025-01-02T030405-a-b-c"
    records = spark.createDataFrame([(1, "T", list("ABCDEFG"), "J", 2001, "10.1/a", None, "unverified", True, "unknown", ["r"], []), (2, "U", [], None, None, None, "5", "unverified", False, "unknown", [], ["c"])], "position int, title string, authors array<string>, journal string, year int, doi string, pmid string, verification string, ready boolean, status string, reasons array<string>, conflicts array<string>")
    pagination = spark.createDataFrame([("s", "complete", 5, 2, ["e"])], "run string, state string, total_available long, records_returned long, errors array<string>")
    none = spark.createDataFrame([], "source string, stage string, message string")
    m = reports.manifest(records, pagination, none).first()
    assert (m.returned, m.citation_ready, m.partial, m.search_complete) == (2, 1, False, True)
    m = reports.manifest(records, pagination.limit(0), spark.createDataFrame([("s", "x", "m")], none.schema)).first()
    assert (m.partial, m.search_complete, m.issues) == (True, False, 1)
    lines = [r.value for r in reports.report_lines(records).orderBy("position").collect()]
    assert "A, B, C, D, E, F, et al." in lines[0]
    assert "not given" in lines[1]
    folder = str(tmp_path / "run")
    assert reports.write_run(spark, folder, "q", records, pagination, none).count() >= 3
    assert {r.state for r in reports.verify_run(spark, folder).collect()} == {"ok"}
    with pytest.raises(Exception, match="(?i)exist"):
        reports.write_run(spark, folder, "q", records, pagination, none)
    rounds = spark.createDataFrame([(1, 3, 5, 2, 2)], "round int, frontier long, new long, new_relevant long, cumulative_relevant long")
    assert reports.curve(rounds).first().cumulative_relevant == 2
    assert snowball.saturation_svg([(1, 2), (2, 5)]).count("<circle") == 2


def test_batches(spark, tmp_path):
    chosen = spark.createDataFrame([(1, "b", '{"x": 1}'), (2, "a", '{"x": 2}'), (3, "c", '{"x": 3}')], "position int, reference_id string, payload string")
    states = spark.createDataFrame([("b", "completed", 1), ("a", "failed", 2)], "reference_id string, state string, attempts long")
    work = batch.next_work(chosen, states)
    assert [(r.reference_id, r.attempt) for r in work.orderBy("position").collect()] == [("a", 3), ("c", 1)]
    assert [r.reference_id for r in batch.next_work(chosen, states, 1).collect()] == ["a"]
    with pytest.raises(InvalidInput):
        batch.next_work(chosen, states, 0)

    def look(ref, payload):
        if ref == "a":
            raise ValueError("no")
        return {"execution_status": "completed", "match_status": "not_matched" if payload["x"] == 1 else None}

    out = batch.attempt(chosen, look)
    assert {r.reference_id: (r.execution_status, r.match_status, r.error) for r in out.collect()} == {"b": ("completed", "not_matched", None), "a": ("failed", None, "ValueError: no"), "c": ("failed", None, "a match status is required")}
    events = [r.event for r in batch.finish_events(work, out, F.lit("id"), F.lit("t"), "network", True).orderBy("position").collect()]
    path = str(tmp_path / "log")
    last = batch.append(spark, path, events, None)
    lines = archive.log_lines(spark, path)
    v = batch.verify_ledger(lines).first()
    assert (v.valid, v.events) == (True, 2)
    assert len(last) == 64
    assert {(r.reference_id, r.error) for r in batch.selection_errors(chosen.unionByName(chosen.limit(1)), spark.createDataFrame([("a",), ("z",), ("a",), (" ",)], "reference_id string")).collect()} == {("b", "reference_repeated"), ("a", "selected_repeated"), ("z", "selected_missing"), ("", "selected_blank"), ("", "selected_missing")}


def test_ledger_binding(spark):
    def event(previous, **more):
        e = {"schema_version": batch.SCHEMA, "previous_event_hash": previous, **more}
        return e | {"event_hash": sha(canonical(e))}

    a = event(None, x=1)
    b = event(a["event_hash"], x=2)
    logs = {"ok": [a, b], "first": [b], "altered": [a, b | {"x": 3}], "schema": [event(None, schema_version="0")], "tail": [a, b], "text": ["x"], "short": [a | {"event_hash": "1"}]}
    rows = [(k, i + 1, e if isinstance(e, str) else canonical(e), not (k == "tail" and i == 1)) for k, es in logs.items() for i, e in enumerate(es)]
    got = {r.log: (r.valid, r.events, r.failure) for r in batch.verify_ledger(spark.createDataFrame(rows, "log string, line int, value string, ended boolean")).collect()}
    assert got == {"ok": (True, 2, None), "first": (False, 0, "previous_hash"), "altered": (False, 1, "event_hash"), "schema": (False, 0, "schema"), "tail": (False, 1, "truncated_tail"), "text": (False, 0, "invalid_json"), "short": (False, 0, "hash_shape")}
    chosen = spark.createDataFrame([(1, "b", '{"x": 1}')], "position int, reference_id string, payload string")
    h = batch.selection_hash(chosen).withColumn("context_sha256", F.lit(A))
    bound = F.struct("ids", "references_sha256", "context_sha256")
    head = F.struct(F.lit("batch_initialized").alias("event_type"), F.col("ids").alias("selected_reference_ids"), "references_sha256", F.col("context_sha256").alias("batch_context_sha256"), batch.batch_id(F.col("references_sha256"), F.col("context_sha256"), F.col("ids")).alias("batch_id"), F.lit(False).alias("semantic_support_assessed"))
    other = F.struct("ids", F.lit("z").alias("references_sha256"), "context_sha256")
    r = h.select(batch.binding_error(head, bound).alias("a"), batch.binding_error(head, other).alias("b")).first()
    assert (r.a, r.b) == (None, "references")


EDGES = {"1": (["2", "3"], ["4"]), "2": (["5"], []), "3": ([], ["6"]), "4": (["2", "7"], []), "5": (["1"], []), "7": (["8"], [])}


def _graph(spark):
    links = [(a, b, i + 1, len(bs), way) for a, sides in EDGES.items() for way, bs in zip(("backward", "forward"), sides, strict=True) for i, b in enumerate(bs)]
    links.append(("1", None, 3, 3, "backward"))
    core = [(str(k), f"10.1/{k}", f"good paper number {k} with a long title" if k != 3 else "another kind of work altogether", None) for k in range(1, 8)]
    return spark.createDataFrame(links, "src string, dst string, pos int, total long, direction string"), spark.createDataFrame(core, "pmid string, doi string, title string, abstract string")


def test_expansion(spark):
    links, core = _graph(spark)
    seeds = spark.createDataFrame([(None, "10.1/1", "seed")], "pmid string, doi string, title string")
    resolver = spark.createDataFrame([("10.1/1", "1")], "doi string, pmid string")
    found, rounds = snowball.expand(seeds, links, core, Rule.parse(["good"]), resolver=resolver)
    assert {(r.round, r.pmid, r.relevant) for r in found.collect()} == {(1, "2", True), (1, "3", False), (1, "4", True), (2, "5", True), (2, "7", True)}
    log = rounds.orderBy("round").collect()
    assert [(r.frontier, r.new_relevant, r.new_not_relevant, r.links_without_pmid, r.unresolved, r.cumulative_relevant, r.stop) for r in log] == [(1, 2, 1, 1, 0, 2, ""), (2, 2, 0, 0, 0, 4, ""), (2, 0, 0, 0, 1, 4, "saturated")]
    _, rounds = snowball.expand(seeds, links, core, Rule.parse(["good"]), snowball.Limits(rounds=1, per_paper=1, per_round=1), resolver=resolver)
    r = rounds.first()
    assert (r.papers_truncated, r.over_budget, r.new, r.stop) == (1, 1, 1, "round_limit")
    _, rounds = snowball.expand(seeds.limit(0), links, core, Rule.parse(["good"]))
    assert rounds.count() == 0
    for bad in ({"rounds": 0}, {"directions": ("up",)}, {"stop_at": -1}):
        with pytest.raises(InvalidInput):
            snowball.Limits(**bad)


def test_accepting_is_greedy(spark):
    rows = spark.createDataFrame([(1, ["d:a"]), (2, ["d:a", "t:b"]), (3, ["t:b"]), (4, ["d:seen"]), (5, []), (6, ["x"])], "seq long, keys array<string>")
    got = snowball.accepted(rows, spark.createDataFrame([("d:seen",)], "key string"))
    assert sorted(r.seq for r in got.collect()) == [1, 3, 5, 6]


def test_graph_of_works(spark):
    works = spark.createDataFrame([("W1", "1"), ("W2", "2"), ("W3", None)], "record_id string, pmid string")
    edges = spark.createDataFrame([("W1", "W2", 0), ("W1", "W3", 1), ("W2", "W1", 0)], "src string, dst string, pos int")
    got = {(r.src, r.dst, r.direction, r.total) for r in snowball.work_graph(edges, works).collect()}
    assert got == {("1", "2", "backward", 2), ("1", None, "backward", 2), ("2", "1", "backward", 1), ("2", "1", "forward", 1), ("1", "2", "forward", 1)}


def test_versions(spark):
    from quillspark.operators import versions

    schema = "subject string, relation string, object string, evidence_ids array<string>, confirmed boolean"
    rows = [("a", "preprint_of", "b", ["e1"], None), ("a", "preprint_of", "b", ["e2", "e1"], True), ("b", "version_of_record_of", "c", ["e"], None), ("c", "preprint_of", "b", ["e"], None), ("d", "preprint_of", "d", ["e"], None), ("e", "possible_same_study", "a", [], None), ("a", "possible_same_study", "e", ["e"], None), ("x", "odd", "y", ["e"], None)]
    df = spark.createDataFrame(rows, schema)
    kept = versions.edges(df).collect()
    assert [(r.subject, r.relation, r.object) for r in kept] == sorted({r[:3] for r in rows})
    assert next(r for r in kept if r.subject == "a" and r.object == "b").evidence_ids == ["e1", "e2"]
    assert {(r.subject, r.object, r.error) for r in versions.edge_errors(df).collect()} == {("b", "c", "cycle"), ("c", "b", "cycle"), ("d", "d", "self"), ("e", "a", "evidence_missing"), ("x", "y", "relation")}


def test_documents_and_downloads(spark):
    body = JATS.replace(" B ", "word " * 60)
    pdf = b"%PDF-1.7 ... startxref 9 %%EOF"
    rows = {"ok": ("application/pdf", pdf), "not a PDF": ("application/pdf", b"x" + pdf), "no end mark": ("application/pdf", pdf[:-5]), "no cross-reference": ("application/pdf", b"%PDF- %%EOF"), "xml": ("text/xml; charset=x", body.encode()), "body too short": ("text/xml", JATS.encode()), "structure": ("application/jats+xml", b"<article/>"), "content type": ("text/html", b"x"), "empty": ("application/pdf", b"")}
    df = spark.createDataFrame([(k, t, bytearray(b)) for k, (t, b) in rows.items()], "key string, content_type string, body binary")
    assert {r.key: r.error for r in access.document_errors(df).collect()} == {k: k for k in rows if k not in ("ok", "xml")}
    records = spark.createDataFrame([("1", "t", "10.1/a", None, "PMC1", "open", "cc by"), ("2", "t", None, "5", None, "unknown", None), ("3", "t", None, None, None, "unknown", None)], "key string, title string, doi string, pmid string, pmcid string, access string, license string")
    d = access.decisions(records, spark.createDataFrame([], "doi string, url string, landing_url string, license string, version string"))
    assert {r.key: (r.category, r.landing_url) for r in d.collect()} == {"1": ("oa_machine_readable", "https://europepmc.org/articles/PMC1"), "2": ("needs_institutional_access", "https://pubmed.ncbi.nlm.nih.gov/5/"), "3": ("no_identifier", None)}
    assert [r.key for r in access.downloads(d, 1).collect()] == ["1"]
