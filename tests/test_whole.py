"""Queries against brute force over whole inputs."""

import difflib

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph
from quillspark.plans import catalogue

from .conftest import SF


@pytest.fixture(scope="module")
def near(spark):
    """Neighbours of each order by any shared part."""
    by_part, by_order = {}, {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect():
        by_part.setdefault(r.l_partkey, set()).add(r.l_orderkey)
        by_order.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    return {o: set().union(*(by_part[p] for p in ps)) - {o} for o, ps in by_order.items()}


def test_expansion_takes_all_parts(spark, near):
    keys = [r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    seen = {o: 0 for o in keys if o < 3}
    for k in range(1, 5):
        for o in set().union(*(near.get(o, set()) for o, at in seen.items() if at == k - 1)) - seen.keys():
            seen[o] = k
    assert {(r.node, r.round) for r in catalogue.q_snowball(spark, SF).collect()} == set(seen.items())
    found = [sum(at == k for at in seen.values()) for k in range(1, 5)]
    assert [(r.round, r.found, r.total) for r in catalogue.q_curve(spark, SF).orderBy("round").collect()] == [(k, found[k - 1], sum(found[:k])) for k in range(1, 5)]


def test_caps_take_all_parts(spark, near):
    want = {(o, min(len(n), 2), len(n) > 2) for o, n in near.items() if n}
    assert {tuple(r) for r in catalogue.q_caps(spark, SF).collect()} == want


def test_shared_key_rounds(spark):
    member = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (3, 8), (4, 8), (5, 9)], "node long, key long")
    seen = graph.expand_shared(member, spark.createDataFrame([(1,)], "node long"), 5)
    assert {(r.node, r.round) for r in seen.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {(r.node, r.n) for r in graph.neighbour_counts(member, 2).collect()} == {(1, 2), (2, 2), (3, 2), (4, 1)}


def test_long_chain_is_not_a_cycle(spark):
    chain = spark.range(140).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = spark.createDataFrame([(1000, 1001), (1001, 1000)], "src long, dst long")
    assert {r.node for r in graph.on_cycle(chain.unionByName(ring).coalesce(1)).collect()} == {1000, 1001}


def test_result_order_has_all_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    title = catalogue.text.normalize_title(F.col("text"))
    rows = catalogue._ready(spark, sf).select("doc_id", "ready", "n_chars", title.alias("title")).collect()
    want = [r.doc_id for r in sorted(rows, key=lambda r: (not r.ready, -(2000 + r.n_chars % 25), r.title, r.doc_id))]
    got = catalogue.q_result_order(spark, sf).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(1, len(want) + 1))


def test_titles_are_whole(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.title for r in catalogue.q_norm_title(spark, SF).collect()}
    assert got == {d: catalogue.text._title(t) for d, t in rows.items()}


def test_records_of_a_cluster_meet(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    cluster = {r.seq: r.cluster for r in catalogue.q_merge_exact(spark, SF).collect()}
    groups = {}
    for d, c in cluster.items():
        groups.setdefault(c, []).append(docs[d])
    rank = {"src0": 0, "src1": 1, "src2": 2}
    want = {(c, min(g, key=lambda r: (rank.get(r.source, 3), r.source, r.doc_id)).doc_id, len(g) - 1, len({r.text.lower() for r in g}) > 1) for c, g in groups.items()}
    assert {tuple(r) for r in catalogue.q_provenance(spark, SF).collect()} == want
    title = lambda d: catalogue.text._title(catalogue.text._title(docs[d].text)[:80])
    same = {(d, c, round(difflib.SequenceMatcher(None, title(c), title(d)).ratio(), 6)) for d, c in cluster.items() if d != c}
    assert {tuple(r) for r in catalogue.q_similarity(spark, SF).collect()} == same
