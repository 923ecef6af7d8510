"""Rounds over edge tables: component labels, citation expansion and cycle checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import saved


def labels(membership: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``node``, ``component`` (least node reachable) of a membership table ``node``, ``key``: nodes that share a key are linked.

    Keys of one node link nothing and nodes without any other are left out of the rounds."""
    every = saved(membership.select("node", "key").distinct(), "membership")
    shared = saved(every.groupBy("key").count().where("count > 1").select("key"), "shared-keys")
    member = saved(every.join(shared, "key", "left_semi"), "linked")
    alone = every.select("node").distinct().join(member.select("node").distinct(), "node", "left_anti").select("node", F.col("node").alias("component"))
    now = member.groupBy("node").agg(F.min("node").alias("component"))
    for _ in range(most_rounds):
        by_key = member.join(now, "node").groupBy("key").agg(F.min("component").alias("least"))
        nearest = member.join(by_key, "key").groupBy("node").agg(F.min("least").alias("component"))
        # a label's own label is a shortcut
        jump = nearest.withColumnRenamed("node", "n").withColumnRenamed("component", "c")
        new = saved(nearest.join(jump, nearest.component == jump.n, "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component")), "labels")
        if new.join(now.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return new.unionByName(alone)
        now = new
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def expand(edges: DataFrame, seeds: DataFrame, rounds: int, cap: int | None = None, per_node: int | None = None, stop_at: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes reached from ``seeds`` (``node``) over ``edges`` (``src``, ``dst``), with their round; and a log of rounds.

    Each round takes the neighbours of the frontier that were not seen, at most ``per_node`` of each and ``cap`` in all
    (the first by node); those beyond the cap stay unseen. It ends when a round finds at most ``stop_at``."""
    spark = edges.sparkSession
    seen = saved(seeds.select("node", F.lit(0).alias("round")).distinct(), "seen")
    log, reason = [], "cap"
    for k in range(1, rounds + 1):
        near = edges.join(seen.where(F.col("round") == k - 1).select(F.col("node").alias("src")), "src")
        if per_node is not None:
            near = near.withColumn("p", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("p") <= per_node)
        new = near.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        if cap is not None:
            new = new.orderBy("node").limit(cap)
        seen = saved(seen.unionByName(new.withColumn("round", F.lit(k))), "seen")
        found = seen.where(F.col("round") == k).count()
        log.append((k, found))
        if found <= stop_at:
            reason = "saturated"
            break
    return seen, spark.createDataFrame([(k, n, reason if k == len(log) else "") for k, n in log], "round int, found long, stop string")


def expand_shared(incidence: DataFrame, seeds: DataFrame, rounds: int, stop_at: int = 0) -> DataFrame:
    """Nodes reached from ``seeds`` (``node``), with their round, where nodes of one key (``node``, ``key``) are neighbours.

    A round goes from the frontier to its keys and from those to their nodes, so no pairs of nodes are made; a key is
    taken once, since all its nodes are seen after that."""
    member = saved(incidence.select("node", "key").where("node IS NOT NULL AND key IS NOT NULL").distinct(), "incidence")
    seen = saved(seeds.select("node", F.lit(0).alias("round")).distinct(), "seen")
    used = None
    for k in range(1, rounds + 1):
        keys = member.join(seen.where(F.col("round") == k - 1).select("node"), "node").select("key").distinct()
        keys = saved(keys if used is None else keys.join(used, "key", "left_anti"), "keys")
        used = keys if used is None else saved(used.unionByName(keys), "used")
        new = member.join(keys, "key").select("node").distinct().join(seen.select("node"), "node", "left_anti")
        seen = saved(seen.unionByName(new.withColumn("round", F.lit(k))), "seen")
        if seen.where(F.col("round") == k).count() <= stop_at:
            break
    return seen


def neighbour_counts(incidence: DataFrame, most: int) -> DataFrame:
    """``node`` and ``n``, its distinct neighbours (nodes that share a key) counted up to ``most``; nodes without one are left out.

    The first ``most`` + 1 nodes of each key suffice for that: they hold ``most`` others for any node, or all there are."""
    member = saved(incidence.select("node", "key").where("node IS NOT NULL AND key IS NOT NULL").distinct(), "incidence")
    few = member.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("node"))).where(F.col("k") <= most + 1)
    near = member.join(few.select("key", F.col("node").alias("other")), "key").where("node <> other").select("node", "other").distinct()
    return near.groupBy("node").agg(F.least(F.count("*"), F.lit(most)).alias("n"))


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or between cycles: nodes without a way in or out are taken away until none is left to take.

    A round takes one node off each end of a path, and there are as many rounds as that needs."""
    e = saved(edges.select("src", "dst").distinct(), "edges")
    left = e.count()
    while left:
        ins, outs = e.select(F.col("dst").alias("n")).distinct(), e.select(F.col("src").alias("n")).distinct()
        e = saved(e.join(ins, e.src == ins.n, "left_semi").join(outs, e.dst == outs.n, "left_semi"), "edges")
        now = e.count()
        if now == left:
            break
        left = now
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
