"""Batch ledgers as append-only event tables, read whole or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_of(last_type: Column, last_status: Column) -> Column:
    """An attempt that started and did not finish is pending again."""
    return F.when(last_type == "attempt_finished", last_status).otherwise("pending")


def latest(events: DataFrame) -> DataFrame:
    """``reference_id``, ``state`` and ``attempts`` from ``seq``, ``reference_id``, ``event_type``, ``status``; the same plan serves a batch and, in update mode, a stream."""
    out = events.groupBy("reference_id").agg(F.max_by(F.struct("event_type", "status"), "seq").alias("last"), F.count_if(F.col("event_type") == "attempt_started").alias("attempts"))
    return out.select("reference_id", state_of(F.col("last.event_type"), F.col("last.status")).alias("state"), "attempts")


def resume(selection: DataFrame, states: DataFrame) -> DataFrame:
    """Selected references that are not completed, in the order of the selection."""
    return selection.join(states, "reference_id", "left").select("position", "reference_id", F.coalesce("state", F.lit("pending")).alias("state")).where("state <> 'completed'")


def batch_status(states: DataFrame) -> DataFrame:
    """One row: the counts of states, and what the batch as a whole is."""
    kinds = ("completed", "partial", "failed", "pending")
    row = states.agg(F.count("*").alias("n"), *(F.count_if(F.col("state") == k).alias(k) for k in kinds))
    whole = F.when(F.col("completed") == F.col("n"), "completed").when(F.col("pending") == F.col("n"), "pending").when(F.col("failed") == F.col("n"), "failed").otherwise("partial")
    return row.select(*kinds, whole.alias("batch_status"))


def stream(events: DataFrame, sink: str, checkpoint: str):
    """Runs ``latest`` over a streaming table into an in-memory sink, whatever has arrived."""
    return latest(events).writeStream.outputMode("complete").format("memory").queryName(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
