"""Golden vectors and small brute-force parities."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import policy, text, urls
from quillspark.operators import graph, resolve
from quillspark.plans.rules import Rule
from quillspark.sources import payloads
from quillspark.streaming import ledger


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(("raw", "doi"), [("https://doi.org/10.1/A", "10.1/a"), ("doi: 10.1/a.", "10.1/a"), (" 10.1/a ; ", "10.1/a"), ("10.1", None), ("x", None), ("", None), (None, None)])
def test_doi(spark, raw, doi):
    assert one(spark, raw, text.normalize_doi) == doi


@pytest.mark.parametrize(("raw", "title"), [("Résumé of X", "re sume of x"), ("Straße ﬁn", "strasse fin"), ("日本", ""), (None, None)])
def test_title(spark, raw, title):
    assert one(spark, raw, text.normalize_title) == title


@pytest.mark.parametrize(("group", "numbers"), [("1-3,5", [1, 2, 3, 5]), ("5-1", []), ("1-400; 7", [7]), ("a, 2", [2])])
def test_citations(spark, group, numbers):
    assert one(spark, group, text.expand_citations) == numbers


@pytest.mark.parametrize(("label", "status"), [("Retraction_of Publication", "retracted"), ("ErratumFor", "correction"), ("expression-of-concern", "expression_of_concern"), ("review", None), (None, None)])
def test_labels(spark, label, status):
    assert one(spark, label, policy.classify_label) == status


@pytest.mark.parametrize(("raw", "norm"), [("http://creativecommons.org/licenses/by-nc/3.0/us/", "cc by nc 3.0"), ("Creative Commons BY", "cc by"), ("https://creativecommons.org/publicdomain/zero/", "cc0 1.0"), ("", None), ("NONE", "none")])
def test_licence(spark, raw, norm):
    assert one(spark, raw, policy.normalize_license) == norm


@pytest.mark.parametrize(("url", "safe"), [("https://a.org/x", True), ("ftp://a.org", False), ("http://u@a.org", False), ("http://10.0.0.1/", False), ("http://172.20.1.1/", False), ("http://printer.local/", False), ("http://8.8.8.8/", True), (None, False)])
def test_safe_url(spark, url, safe):
    assert one(spark, url, urls.safe_http) is safe


def test_canonical_url(spark):
    assert one(spark, "HTTP://User:p@Host.ORG:80?b=2&token=x&A=1#f", urls.canonical) == "http://host.org/?A=1&b=2"


def test_gates_fail_closed(spark):
    row = spark.sql("select cast(null as boolean) b, cast(null as string) s").select(policy.citation_ready(F.col("b"), F.lit(0), F.col("b"), F.col("s"), F.col("b")).alias("r"), policy.assess_license(F.col("s"), F.col("s")).alias("l")).first()
    assert row.r is False
    assert row.l == "unknown"


def test_rule():
    with pytest.raises(ValueError):
        Rule.parse(["|"])
    with pytest.raises(ValueError):
        Rule.parse(["a"], [], ["b"])
    assert Rule.parse(["a| b "], ["x|x"]).excludes == ("x",)


def _global_fold(records):
    """The fold over all records at once, in order."""
    level = {"key": {}, "pmid": {}, "title": {}}
    first, out = {}, {}
    for seq, doi, pmid, norm in records:
        names = [f"doi:{doi}" if doi else f"pmid:{pmid}" if pmid else f"title:{norm}"] + ([f"pmid:{pmid}"] if pmid else []) + [f"title:{norm}"]
        c = next((level[m][n] for n in names for m in level if n in level[m]), seq)
        r = first.setdefault(c, [doi, pmid, norm])
        r[0], r[1] = r[0] or doi, r[1] or pmid
        level["key"][f"doi:{r[0]}" if r[0] else f"pmid:{r[1]}" if r[1] else f"title:{r[2]}"] = c
        if r[1]:
            level["pmid"][f"pmid:{r[1]}"] = c
        level["title"][f"title:{r[2]}"] = c
        out[seq] = c
    return out


def test_merge_equals_global_fold(spark):
    rng = random.Random(5)
    recs = [(i, rng.choice([None, None, *"abcdefgh"]), rng.choice([None, None, *"1234567"]), rng.choice("uvwxyzklmnop") + str(rng.randint(0, 9))) for i in range(160)]
    df = spark.createDataFrame(recs, "seq long, doi string, pmid string, norm string")
    got = {r.seq: r.cluster for r in resolve.clusters(df).collect()}
    assert got == _global_fold(recs)


def test_expand_and_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src long, dst long")
    seen, log = graph.expand(e, spark.createDataFrame([(1,)], "node long"), 5)
    assert {(r.node, r.round) for r in seen.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert [r.stop for r in log.orderBy("round").collect()][-1] == "saturated"
    assert {r.node for r in graph.on_cycle(e).collect()} == {2, 3}


def test_payloads(spark):
    body = json.dumps({"results": [{"id": "https://x.org/W12", "title": "T", "doi": "https://doi.org/10.1/A", "ids": {"pmid": "https://p/99"}, "publication_year": 2001, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "referenced_works": ["https://x.org/w7"]}]})
    df = spark.createDataFrame([("r1", body), ("r2", "not json")], "request_id string, body string")
    w = payloads.openalex(df)
    r = w.select("*", text.rebuild_inverted(F.col("abstract_index")).alias("abstract")).first()
    assert (r.doi, r.pmid, r.work, r.abstract) == ("10.1/a", "99", "W12", "a b a")
    assert [(x.src, x.dst) for x in payloads.openalex_edges(w).collect()] == [("W12", "W7")]
    assert [x.request_id for x in payloads.issues(df, "works", payloads.OPENALEX, "p.results").collect()] == ["r2"]
    summary = json.dumps({"result": {"uids": ["1"], "1": {"title": "T", "articleids": [{"idtype": "doi", "value": "10.1/B"}], "authors": [{"name": "A"}], "pubtype": ["Retracted Publication"], "pubdate": "2010 Jan", "source": "J"}}})
    p = payloads.pubmed(spark.createDataFrame([("r", summary)], "request_id string, body string")).first()
    assert (p.pmid, p.doi, p.year, p.flagged) == ("1", "10.1/b", 2010, True)


def test_ledger_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a", "attempt_started", None), (2, "a", "attempt_finished", "completed"), (3, "b", "attempt_started", None)]
    df = spark.createDataFrame(rows, "seq long, reference_id string, event_type string, status string")
    df.write.parquet(str(tmp_path / "in"))
    ledger.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ledger_now", str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(spark.table("ledger_now").collect()) == sorted(ledger.latest(df).collect())
    assert ledger.batch_status(ledger.latest(df)).first().batch_status == "partial"


def test_page_text_is_cleaned(spark):
    from quillspark.functions.text import clean_page

    cases = {"a ﬁne exam-\n ple": "a fine example", "J 20 0 5;49": "J 2005;49", "20 0 5 x": "20 0 5 x", " a\t b\n\n c ": "a b c", "": "", "é-\né": "éé", "a -\nb": "a - b"}
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r.t: r.c for r in rows.select("t", clean_page(F.col("t")).alias("c")).collect()}
    assert got == {**cases, None: None}


def test_chain_failures(spark):
    import hashlib

    from quillspark.functions.hashing import GENESIS
    from quillspark.operators.audit import chain_failures

    def log(name, payloads):
        before, out = GENESIS, []
        for k, p in enumerate(payloads, 1):
            digest = hashlib.sha256(f"{before}|{p}".encode()).hexdigest()
            out.append([name, k, p, before, digest])
            before = digest
        return out

    rows, want = log("good", "abc"), {"good": (3, None, None)}
    bad = log("null payload", "abc")
    bad[1][2] = None
    rows += bad
    want["null payload"] = (3, 2, "event_hash")
    bad = log("null before", "abc")
    bad[0][3] = None
    rows += bad
    want["null before"] = (3, 1, "previous_hash")
    bad = log("repeat", "ab")
    rows += [*bad, bad[0]]
    want["repeat"] = (3, 1, "sequence")
    rows += log("gap", "abcd")[1:]
    want["gap"] = (3, 2, "sequence")
    events = spark.createDataFrame(rows, "log string, seq int, payload string, previous string, digest string")
    got = chain_failures(events, "log").collect()
    assert {r.log: (r.events, r.first_bad, r.failure) for r in got} == want
    assert chain_failures(events.limit(0), "log").count() == 0


def test_entries_run_over_lines_and_pages(spark):
    from quillspark.operators.references import entries

    rows = [(1, 1, 1, "References"), (1, 1, 2, "[1] A."), (1, 1, 3, "more"), (1, 2, 1, "and more"), (1, 2, 2, " [22]  B."), (1, 2, 3, None), (2, 1, 1, "no marker [3] here")]
    lines = spark.createDataFrame(rows, "doc int, page int, line int, text string")
    assert sorted(map(tuple, entries(lines).collect())) == [(1, 1, 1, 3, "A. more and more"), (1, 22, 2, 2, "B. ")]
    assert entries(lines.limit(0)).count() == 0


def test_best_of_equal_scores_by_order(spark):
    from quillspark.operators.references import best

    rows = spark.createDataFrame([("a", 0.5, 2), ("a", 0.5, 1), ("a", 0.9, 3), ("a", None, 0), ("b", None, 4)], "k string, s double, seq int")
    assert sorted((r.k, r.place, r.seq) for r in best(rows, "k", "s", "seq", 2).collect()) == [("a", 1, 3), ("a", 2, 1), ("b", 1, 4)]


def test_quote_matches_are_given_out_in_bounded_parts(spark):
    """Texts of 100,000 characters that hold 60 quotes each: no part of the matches has more than the bound, and counting takes no texts along."""
    import pyarrow as pa

    from quillspark.operators import quotes

    held = {f"q{i}.": [i, 100 + i] for i in range(60)}
    text_ = "é" * 100_000 + "".join(held) + "q1.q1."
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": [text_] * 3 + [None, ""]})
    for with_text in (True, False):
        parts = list(quotes._finder(lambda: held, with_text)(iter([batch])))
        assert max(sum(len(t) for t in p.column("text").to_pylist()) if with_text else p.num_rows for p in parts) <= (quotes.OUT_BYTES if with_text else quotes.OUT_ROWS)
        got = [x for p in parts for x in p.to_pylist()]
        assert len(got) == 3 * 120
        assert {(x["quote"], x["n"], x["at"]) for x in got} == {(q, 3 if q == "q1." else 1, text_.index(q)) for q in held}
    docs = spark.createDataFrame([(1, "aaaa b"), (2, "x"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "aa"), (8, "b"), (9, ""), (10, None)], "item_id long, quote string")
    assert "text" not in quotes.located(q, docs).columns
    assert sorted(map(tuple, quotes.located(q, docs).collect())) == [(1, 7, "aa", 2, 0), (1, 8, "b", 1, 5)]
    assert sorted(map(tuple, quotes.contained(q, docs).collect())) == [(1, 7, "aa", "aaaa b"), (1, 8, "b", "aaaa b")]
