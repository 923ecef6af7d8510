"""Versions of works as a graph of statements, each with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import on_cycle

#: What one version may be to another; the last one says nothing about order.
RELATIONS = ("preprint_of", "accepted_manuscript_of", "version_of_record_of", "corrected_version_of", "retracted_version_of", "translation_of", "possible_same_study")
UNORDERED = "possible_same_study"


def edges(statements: DataFrame) -> DataFrame:
    """Statements (``subject``, ``relation``, ``object``, ``evidence_ids``, ``confirmed``) each once, with all their evidence, in order (subject, relation, object): saying a thing again adds nothing but evidence."""
    one = statements.groupBy("subject", "relation", "object").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"), F.bool_or(F.coalesce("confirmed", F.lit(False))).alias("confirmed"))
    return one.orderBy("subject", "relation", "object")


def edge_errors(statements: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """``subject``, ``relation``, ``object`` and ``error`` of statements that cannot stand: of a thing about itself, without evidence, of an unknown relation, or on a cycle of ordered relations."""
    e = edges(statements)
    own = F.array_compact(F.array(F.when(F.coalesce(F.col("subject") == F.col("object"), F.lit(True)), "self"), F.when(~F.coalesce(F.exists("evidence_ids", lambda x: F.trim(x) != ""), F.lit(False)), "evidence_missing"), F.when(~F.coalesce(F.col("relation").isin(*relations), F.lit(False)), "relation")))
    rows = e.select("subject", "relation", "object", F.explode(own).alias("error"))
    ordered = e.where((F.col("relation") != UNORDERED) & (F.col("subject") != F.col("object")))
    ring = on_cycle(ordered.select(F.col("subject").alias("src"), F.col("object").alias("dst"))).withColumnRenamed("src", "node")
    cyclic = ordered.join(ring.select(F.col("node").alias("subject")), "subject", "left_semi").join(ring.select(F.col("node").alias("object")), "object", "left_semi")
    return rows.unionByName(cyclic.select("subject", "relation", "object", F.lit("cycle").alias("error")))
