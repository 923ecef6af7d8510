"""Post-publication status of a DOI from a configured provider or, where that fails, from a registry's two public answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.hashing import evidence_id
from ..functions.text import normalize_doi

PROVIDER, WORK, UPDATES = "normalized_provider", "crossref_work", "crossref_updates"
MOST_BYTES = 5_000_000
#: Relations of a work that say what became of it.
RELATIONS = {"is-retracted-by": "retracted", "is-corrected-by": "correction", "is-expression-of-concern-by": "expression_of_concern"}
_NORMALIZED = "target_doi string, updates array<struct<target_doi:string,type:string>>"
_WORK = "message struct<DOI:string,`update-policy`:string,relation:map<string,array<string>>>"
_UPDATES = "message struct<`total-results`:long,items:array<struct<`update-to`:array<struct<DOI:string,type:string>>>>>"


def _bound(dois: Column, target: Column) -> Column:
    return F.filter(dois, lambda u: normalize_doi(u["DOI"]).eqNullSafe(target))


def responses(rows: DataFrame) -> DataFrame:
    """What each response says and why it cannot be used, from ``target`` (a normalised doi), ``route`` (provider or fallback), ``provider``, ``kind``, ``status_code``, ``url``, ``retrieved_at``, ``body``."""
    text = F.col("body").cast("string")
    norm, work, ups = (F.from_json(text, s) for s in (_NORMALIZED, _WORK, _UPDATES))
    r = rows.withColumns({"is_object": F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)), "norm": norm, "work": work, "ups": ups})
    items = F.col("ups.message.items")
    updates = F.transform(items, lambda i: _bound(i["update-to"], F.col("target")))
    loose = F.exists("norm.updates", lambda u: ~normalize_doi(u["target_doi"]).eqNullSafe(F.col("target")))
    error = (
        F.when((F.col("status_code") < 200) | (F.col("status_code") >= 300), "status").when(F.octet_length("body") > MOST_BYTES, "too_large").when(~F.col("is_object"), "not_an_object")
        .when((F.col("kind") == PROVIDER) & ~normalize_doi(F.col("norm.target_doi")).eqNullSafe(F.col("target")), "target").when((F.col("kind") == PROVIDER) & F.col("norm.updates").isNull(), "updates_missing").when((F.col("kind") == PROVIDER) & loose, "update_target")
        .when((F.col("kind") == WORK) & ~normalize_doi(F.col("work.message.DOI")).eqNullSafe(F.col("target")), "target")
        .when((F.col("kind") == UPDATES) & items.isNull(), "items_missing").when((F.col("kind") == UPDATES) & (F.coalesce("ups.message.total-results", F.size(items)) != F.size(items)), "incomplete")
        .when((F.col("kind") == UPDATES) & F.exists(updates, lambda u: F.coalesce(F.size(u), F.lit(0)) <= 0), "item_target").when(~F.col("kind").isin(PROVIDER, WORK, UPDATES), "kind")
    )
    said = lambda prefix, types: F.array_compact(F.transform(types, lambda t: F.when(policy.classify_crossmark(t).isNotNull(), F.struct(policy.classify_crossmark(t).alias("status"), F.concat(F.lit(prefix), policy.classify_crossmark(t)).alias("signal")))))
    names = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    full = F.filter(F.map_entries("work.message.relation"), lambda e: F.size(e["value"]) > 0)
    related = F.array_compact(F.transform(full, lambda e: F.when(names[F.replace(F.lower(F.trim(e["key"])), F.lit("_"), F.lit("-"))].isNotNull(), F.struct(names[F.replace(F.lower(F.trim(e["key"])), F.lit("_"), F.lit("-"))].alias("status"), F.concat(F.lit("crossref:relation:"), names[F.replace(F.lower(F.trim(e["key"])), F.lit("_"), F.lit("-"))]).alias("signal")))))
    signals = F.when(F.col("kind") == PROVIDER, said("configured_provider:update:", F.transform("norm.updates", lambda u: u["type"]))).when(F.col("kind") == WORK, related).when(F.col("kind") == UPDATES, said("crossref:update-to:", F.transform(F.flatten(updates), lambda u: u["type"])))
    digest = F.sha2("body", 256)
    evidence = F.struct(F.col("provider").alias("source"), "url", "retrieved_at", digest.alias("response_sha256"), evidence_id(F.col("provider"), F.col("kind"), F.col("target"), F.col("url"), digest).alias("evidence_id"))
    declared = F.when(F.col("kind") == WORK, F.coalesce(F.col("work.message.update-policy") != "", F.lit(False)))
    return r.select("target", "route", "provider", "kind", error.alias("error"), F.coalesce(signals, F.array().cast("array<struct<status:string,signal:string>>")).alias("signals"), evidence.alias("evidence"), declared.alias("declared"))


def assess(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """``target``, ``status``, ``complete``, ``route``, ``provider``, ``fallback_used``, ``declared``, ``signals``, ``n_evidence`` and ``errors`` of each ``target``.

    A route counts only if it has answers, all of one provider, without error, and exactly its kinds: the provider's own, or the registry's work and
    updates. The provider goes first; if neither counts the assessment has failed, and its status is unknown."""
    each = responses(rows)
    good = each.groupBy("target", "route").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_distinct("provider").alias("providers"), F.min("provider").alias("provider"), F.array_sort(F.collect_set("error")).alias("errors"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kind", "signals"))), lambda x: x["signals"])).alias("signals"), F.max("declared").alias("declared"), F.count("*").alias("n_evidence"),
    )
    kinds = F.when(F.col("route") == "provider", F.array(F.lit(PROVIDER))).otherwise(F.array(F.lit(UPDATES), F.lit(WORK)))
    kinds = F.array_sort(kinds)
    failure = F.when(F.size("errors") > 0, F.array_join("errors", "+")).when(F.col("providers") != 1, "provider_identity").when(F.col("kinds") != kinds, "kinds")
    good = good.select("target", "route", F.struct("provider", failure.alias("failure"), "signals", "declared", "n_evidence").alias("r"))
    a = targets.select("target").distinct().join(good.where("route = 'provider'").select("target", F.col("r").alias("p")), "target", "left").join(good.where("route = 'fallback'").select("target", F.col("r").alias("f")), "target", "left")
    from_p, from_f = F.col("p").isNotNull() & F.col("p.failure").isNull(), F.col("f").isNotNull() & F.col("f.failure").isNull()
    used = F.when(F.col("target").isNull(), None).when(from_p, F.col("p")).when(from_f, F.col("f"))
    a = a.withColumn("u", used)
    worst = policy.status_of(F.coalesce(F.array_max(F.transform("u.signals", lambda s: policy.severity(s["status"]))), F.lit(0)))
    signals = F.coalesce(F.array_distinct(F.transform(F.filter("u.signals", lambda s: s["status"] == worst), lambda s: s["signal"])), F.array().cast("array<string>"))
    errors = F.array_compact(F.array(F.when(F.col("target").isNull(), "invalid_doi"), F.when(F.col("p.failure").isNotNull(), F.concat(F.lit("provider: "), F.col("p.failure"))), F.when(~from_p & F.col("f.failure").isNotNull(), F.concat(F.lit("fallback: "), F.col("f.failure"))), F.when(F.col("p").isNull() & F.col("f").isNull(), "no_route")))
    route = F.when(F.col("u").isNull(), "none").when(from_p, "configured_provider").otherwise("crossref_public_rest_fallback")
    return a.select("target", worst.alias("status"), F.col("u").isNotNull().alias("complete"), route.alias("route"), F.col("u.provider").alias("provider"), (F.col("u").isNotNull() & ~from_p & F.col("p").isNotNull()).alias("fallback_used"), F.col("u.declared").alias("declared"), signals.alias("signals"), F.coalesce("u.n_evidence", F.lit(0)).cast("long").alias("n_evidence"), errors.alias("errors"))
