"""Operator 5, SimHash near-duplicates by BK-trees.

Each distinct fingerprint is looked up once. Fingerprints that differ in at most ``RADIUS`` of 64 bits agree in at
least two of six blocks of bits, so they meet in the shard of one of the 15 pairs of blocks. Each shard's fingerprints
form a BK-tree, whose children are keyed by their Hamming distance to the parent, and every fingerprint of the shard
walks it along the edges within the radius. A shard of more than ``HOT`` fingerprints is dealt again by five blocks
of the bits that its key leaves free, of which one must agree, so the search stays exact. A shard returns links that
span its groups, not its pairs.

Null text counts as empty, fingerprint zero; a null doc_id represents no group; repeated rows keep their rows; an empty
table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions, texts, written
from .components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
HOT, LEAF = 4096, 24
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[tuple[int, list[int]]]:
    """For each pair of blocks, the mask of its bits and the masks of five blocks of the other bits."""
    cuts = [0, 11, 22, 33, 44, 54, 64]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for i, j in combinations(range(6), 2):
        key = block[i] | block[j]
        free = [k for k in range(64) if not key >> k & 1]
        out.append((key, [sum(1 << k for k in free[s::5]) for s in range(5)]))
    return out


def simhash(text: str) -> int:
    """The 64-bit fingerprint of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    whole = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.r_[0, ends[: n - 1]].tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(whole[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) and ``t`` (a hash) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(simhash(t)) for t in b.column(1).to_pylist()], pa.int64()), b.column(2)], ["doc_id", "fp", "t"])

    bound_batches(docs.sparkSession)
    return texts(docs).withColumn("t", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, t long")


def bk_groups(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint of a shard, the position of one that stands for all it is linked with, step by step, in the shard."""
    label = np.arange(len(fps))

    def unite(idx: np.ndarray) -> None:
        found = np.unique(label[idx])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]

    everyone = np.arange(len(fps))
    todo = [(everyone, everyone)]
    while todo:
        queries, members = todo.pop()
        if len(members) <= LEAF:
            near = np.bitwise_count(fps[queries][None, :] ^ fps[members][:, None]) <= RADIUS
            for k, row in zip(members, near, strict=True):
                unite(np.append(queries[row], k))
            continue
        root = members[0]
        to_query = np.bitwise_count(fps[queries] ^ fps[root]).astype(np.int64)
        unite(np.append(queries[to_query <= RADIUS], root))
        to_child = np.bitwise_count(fps[members[1:]] ^ fps[root]).astype(np.int64)
        order = np.argsort(to_child, kind="stable")
        edges, first = np.unique(to_child[order], return_index=True)
        for edge, child in zip(edges, np.split(members[1:][order], first[1:]), strict=True):
            if len(sub := queries[np.abs(to_query - edge) <= RADIUS]):
                todo.append((sub, child))
    return label


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the shards, whose rows (shard, part, key, fp) come sorted."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = rows[:, 3].astype(np.uint64)
        edge = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1), True])
        size = np.diff(edge)
        a, b = [], []
        owner = np.repeat(np.arange(len(size)), size)
        small = size[owner] <= LEAF
        for k in range(1, min(LEAF, int(size.max()))):  # small shards are one leaf each, searched together
            hit = np.flatnonzero(small[:-k] & (owner[k:] == owner[:-k]) & (np.bitwise_count(fps[k:] ^ fps[:-k]) <= RADIUS))
            a.append(hit)
            b.append(hit + k)
        for i in np.flatnonzero(size > LEAF):
            label = bk_groups(fps[edge[i] : edge[i + 1]])
            off = np.flatnonzero(label != np.arange(len(label)))
            a.append(edge[i] + label[off])
            b.append(edge[i] + off)
        if a and len(left := np.concatenate(a)):
            yield pa.RecordBatch.from_arrays([pa.array(rows[left, 3]), pa.array(rows[np.concatenate(b), 3])], ["a", "b"])

    for batch in batches:
        rows = np.column_stack([c.to_numpy() for c in batch.columns])
        if not len(rows):
            continue
        new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
        if held and (rows[0, :3] != held[-1][-1, :3]).any():
            yield from links(np.concatenate(held))
            held = []
        if len(new):
            cut = new[-1] + 1
            yield from links(np.concatenate([*held, rows[:cut]]))
            held, rows = [], rows[cut:]
        held.append(rows)
    if held:
        yield from links(np.concatenate(held))


def links(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` that join all that lie within the radius."""
    masks = _masks()
    n = partitions(fps.sparkSession)
    key = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, (m, _) in enumerate(masks)))).alias("s")
    dealt = fps.select("fp", key).select("s.shard", "s.key", "fp")
    hot = dealt.groupBy("shard", "key").count().where(F.col("count") > HOT).select("shard", "key", F.lit(True).alias("hot"))
    parts = F.element_at(F.array(*(F.array(*(F.struct(F.lit(p + 1).cast("long").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m | s))).alias("key")) for p, s in enumerate(subs))) for m, subs in masks)), (F.col("shard") + 1).cast("int"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.col("key").alias("key")))
    rows = dealt.join(hot, ["shard", "key"], "left").select("shard", F.explode(F.when(F.col("hot"), parts).otherwise(whole)).alias("p"), "fp").select("shard", "p.part", "p.key", "fp")
    rows = rows.repartition(n, "shard", "part", "key").sortWithinPartitions("shard", "part", "key")
    return rows.mapInArrow(_search, "a long, b long").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and of each distinct one its group."""
    of = written(fingerprints(docs), "simhash")
    distinct = written(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct.select("fp")))
    return of, written(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest doc_id reachable over links."""
    of, group = _grouped(docs)
    smallest = group.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.join(group.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group, by ``doc_id`` and ``t`` (the hash of its text): the least doc_id (null: last), then the least hash."""
    of, group = _grouped(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("r")
    return of.join(group.select("fp", "root"), "fp").groupBy("root").agg(first).select("r.doc_id", "r.t")
