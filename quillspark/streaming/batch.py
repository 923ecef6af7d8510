"""Runs of a batch of references over a ledger of attempts: what is bound to what, what is left, one attempt each, and the events they leave."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json
from ..functions.validate import InvalidInput, outcome_error

#: Fixed value: the schema that ledger events name.
SCHEMA = "reference_batch_ledger_v1"
OUTCOME = "reference_id string, execution_status string, match_status string, candidates string, issues string, error string"


def selection_hash(selected: DataFrame) -> DataFrame:
    """One row ``references_sha256`` and ``ids``: the digest of the selected references (``position``, ``reference_id``, ``payload`` as JSON) in their order.

    A selection is what one run works through; its identifiers and payload digests meet in one row."""
    item = F.concat(F.lit('{"payload":'), canonical_json(F.col("payload")), F.lit(',"reference_id":'), F.to_json(F.array("reference_id")).substr(F.lit(2), F.length(F.to_json(F.array("reference_id"))) - 2), F.lit("}"))
    rows = selected.agg(F.array_sort(F.collect_list(F.struct("position", "reference_id", F.sha2(item, 256).alias("h")))).alias("rows"))
    return rows.select(F.sha2(F.array_join(F.transform("rows", lambda r: r["h"]), "\n"), 256).alias("references_sha256"), F.transform("rows", lambda r: r["reference_id"]).alias("ids"))


def selection_errors(references: DataFrame, selected: DataFrame) -> DataFrame:
    """``reference_id`` and ``error`` of blank or repeated references, and of selected ones that are blank, repeated or not there."""

    def odd(rows: DataFrame, kind: str) -> DataFrame:
        n = rows.groupBy(F.trim(F.coalesce("reference_id", F.lit(""))).alias("reference_id")).count()
        return n.select("reference_id", F.when(F.col("reference_id") == "", f"{kind}_blank").when(F.col("count") > 1, f"{kind}_repeated").alias("error")).where("error is not null")

    missing = selected.select(F.trim("reference_id").alias("reference_id")).join(references.select(F.trim("reference_id").alias("reference_id")), "reference_id", "left_anti").select("reference_id", F.lit("selected_missing").alias("error"))
    return odd(references, "reference").unionByName(odd(selected, "selected")).unionByName(missing)


def batch_id(references_sha256: Column, context_sha256: Column, ids: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", references_sha256, context_sha256, F.array_join(ids, "|")), 256)


def binding_error(header: Column, bound: Column) -> Column:
    """Why a ledger's header (a struct) does not belong to a selection and its inputs (a struct ``ids``, ``references_sha256``, ``context_sha256``), or null."""
    same = lambda a, b: a.eqNullSafe(b)
    return (
        F.when(~same(header["event_type"], F.lit("batch_initialized")), "not_a_header").when(~same(header["selected_reference_ids"], bound["ids"]), "selection").when(~same(header["references_sha256"], bound["references_sha256"]), "references")
        .when(~same(header["batch_context_sha256"], bound["context_sha256"]), "context").when(~same(header["batch_id"], batch_id(bound["references_sha256"], bound["context_sha256"], bound["ids"])), "batch_id").when(~same(header["semantic_support_assessed"], F.lit(False)), "semantic_support")
    )


def verify_ledger(lines: DataFrame) -> DataFrame:
    """``log``, ``valid``, ``events``, ``failed_line`` and ``failure`` of ledgers of lines ``log``, ``line`` (from 1), ``value``, ``ended`` (whether a line end follows).

    The first event has no previous hash (null); each names the schema, carries 64 digits, the hash before it, and the digest of its canonical JSON without its own hash; the last line must have ended."""
    v = F.col("v")
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    rows = lines.withColumn("v", F.try_parse_json("value"))
    w = Window.partitionBy("log").orderBy("line")
    rows = rows.withColumns({"own": get("event_hash"), "before": F.lag(get("event_hash")).over(w), "last": F.lead("line").over(w).isNull()})
    unhashed = F.regexp_replace(F.regexp_replace(canonical_json(F.col("value")), r'"event_hash":"[^"]*",', ""), r',"event_hash":"[^"]*"', "")
    failure = (
        F.when(F.col("last") & ~F.coalesce("ended", F.lit(False)), "truncated_tail").when(v.isNull(), "invalid_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object").when(~get("schema_version").eqNullSafe(F.lit(SCHEMA)), "schema")
        .when(F.coalesce(F.length("own"), F.lit(0)) != 64, "hash_shape").when(~get("previous_event_hash").eqNullSafe(F.col("before")), "previous_hash").when(~F.sha2(unhashed, 256).eqNullSafe(F.col("own")), "event_hash")
    )
    rows = rows.withColumn("failure", failure)
    first = F.min(F.when(F.col("failure").isNotNull(), F.struct("line", "failure")))
    return rows.groupBy("log").agg(F.count("*").alias("n"), first.alias("f")).select("log", F.col("f").isNull().alias("valid"), F.coalesce(F.col("f.line") - 1, "n").cast("long").alias("events"), F.col("f.line").alias("failed_line"), F.col("f.failure").alias("failure"))


def next_work(selected: DataFrame, states: DataFrame, max_items: int | None = None) -> DataFrame:
    """Selected references (``position``, ``reference_id``, ...) that are not completed, in order, at most ``max_items`` of them, with their next ``attempt``."""
    if max_items is not None and max_items < 1:
        raise InvalidInput("max_items must be positive")
    work = selected.join(states.select("reference_id", "state", "attempts"), "reference_id", "left").where(F.coalesce("state", F.lit("pending")) != "completed")
    work = work.withColumn("attempt", (F.coalesce("attempts", F.lit(0)) + 1).cast("long")).drop("state", "attempts")
    return work if max_items is None else work.orderBy("position").limit(max_items)


def attempt(work: DataFrame, lookup: Callable[[str, dict], dict]) -> DataFrame:
    """Outcomes of ``lookup(reference_id, payload)`` for each reference; one that raises, or breaks the contract of outcomes, has failed, and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ref, payload in zip(b["reference_id"], b["payload"], strict=True):
                try:
                    o = lookup(ref, json.loads(payload))
                    out.append((ref, str(o.get("execution_status", "")), o.get("match_status"), json.dumps(o.get("candidates", [])), json.dumps(o.get("issues", [])), None))
                except Exception as failed:  # noqa: BLE001  an attempt of its own, whatever it dies of
                    out.append((ref, "failed", None, "[]", "[]", f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(out, columns=["reference_id", "execution_status", "match_status", "candidates", "issues", "error"])

    out = work.select("reference_id", "payload").mapInPandas(run, OUTCOME)
    broken = outcome_error(F.col("execution_status"), F.col("match_status"))
    out = out.withColumn("broken", broken)
    return out.select("reference_id", F.when(F.col("broken").isNull(), F.col("execution_status")).otherwise("failed").alias("execution_status"), F.when(F.col("broken").isNull(), F.col("match_status")).alias("match_status"), "candidates", "issues", F.coalesce("error", "broken").alias("error"))


def finish_events(work: DataFrame, outcomes: DataFrame, batch: Column, recorded_at: Column, transport: str, cached: bool) -> DataFrame:
    """Events, as canonical JSON without hashes, that attempts leave: ``position``, ``reference_id``, ``event``. Nothing in them assesses what a source supports."""
    r = work.join(outcomes, "reference_id")
    body = F.struct(F.lit(SCHEMA).alias("schema_version"), F.lit("attempt_finished").alias("event_type"), recorded_at.alias("recorded_at"), batch.alias("batch_id"), "reference_id", F.sha2(canonical_json(F.col("payload")), 256).alias("reference_payload_sha256"), F.col("attempt").alias("attempt_number"), "execution_status", "match_status", F.lit(transport).alias("transport_mode"), F.lit(cached).alias("cache_enabled"), F.try_parse_json("candidates").alias("candidates"), F.try_parse_json("issues").alias("issues"), "error", F.lit("NOT_ASSESSED").alias("semantic_support_status"), F.lit(False).alias("semantic_support_assessed"))
    return r.select("position", "reference_id", canonical_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("event"))


def append(spark, path: str, events: list[str], previous: str | None) -> str | None:
    """Chains events (canonical JSON) after ``previous`` and writes them as one new file of the ledger's folder; returns the last hash. A ledger has one writer: each hash needs the one before it, and a run's events are few."""
    import hashlib

    lines = []
    for e in events:
        body = json.loads(e) | {"previous_event_hash": previous}
        text = lambda b: json.dumps(b, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        previous = hashlib.sha256(text(body).encode()).hexdigest()
        lines.append(text(body | {"event_hash": previous}))
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
    return previous
