"""Verification of records against a registry of works, its update notices and the relations of a second registry.

Lookups are tables: an answer that is missing or lacks its evidence leaves the check incomplete and becomes an issue row;
no signal means unknown, never clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.text import normalize_doi, title_similarity
from ..functions.validate import sha256, status_metadata

#: Fixed value: the least similarity of a record's title to that of the work its identifier leads to.
SAME_TITLE = 0.90
_SIGNAL = "array<struct<status:string,signal:string>>"
_NOTICE = "array<struct<type:string,label:string>>"


def signal(place: str, label: Column) -> Column:
    """A controlled label as its status and where it stood; null for any other label."""
    status = policy.classify_label(label)
    return F.when(status.isNotNull(), F.struct(status.alias("status"), F.concat(F.lit(f"{place}:"), status).alias("signal")))


def notice_signals(place: str, notices: Column) -> Column:
    """Signals of an array of notices, by type and by label."""
    pairs = F.transform(notices, lambda n: F.array(signal(f"{place}.type", n["type"]), signal(f"{place}.label", n["label"])))
    return F.array_compact(F.flatten(F.coalesce(pairs, F.array().cast(f"array<{_SIGNAL}>"))))


def work_signals(kind: Column, subkind: Column, updates: Column, relation: Column) -> Column:
    """Signals of a registry's work: its own types, what it updates, and its relations (a map from name to notices)."""
    names = F.array_compact(F.transform(F.map_keys(relation), lambda k: signal("crossref:relation", k)))
    inside = notice_signals("crossref:relation", F.flatten(F.map_values(relation)))
    own = F.array_compact(F.array(signal("crossref:type", kind), signal("crossref:subtype", subkind)))
    return F.concat(*(F.coalesce(s, F.array().cast(_SIGNAL)) for s in (own, notice_signals("crossref:update-to", updates), names, inside)))


def type_signals(types: Column) -> Column:
    return F.array_compact(F.coalesce(F.transform(types, lambda t: signal("pubmed:publication_type", t)), F.array().cast(_SIGNAL)))


def assess(signals: Column) -> Column:
    """The gravest status of an array of signals and, each once and in order, the signals of that status. Of one source or of all: the same."""
    worst = policy.status_of(F.coalesce(F.array_max(F.transform(signals, lambda s: policy.severity(s["status"]))), F.lit(0)))
    return F.struct(worst.alias("status"), F.array_distinct(F.transform(F.filter(signals, lambda s: s["status"] == worst), lambda s: s["signal"])).alias("signals"))


def lookup_states(lookups: DataFrame) -> DataFrame:
    """``kind``, ``key``, ``answered`` and ``error`` of status lookups (``kind``, ``key``, ``failure``, ``retrieved_at``, ``response_sha256``, ``url``): the last of each key."""
    ok = F.col("failure").isNull() & status_metadata(F.col("retrieved_at"), F.col("response_sha256"), F.col("url"))
    error = F.when(~ok, F.coalesce("failure", F.lit("evidence of the lookup is incomplete")))
    return lookups.groupBy("kind", "key").agg(F.max_by(F.struct(ok.alias("answered"), error.alias("error")), F.coalesce("retrieved_at", F.lit(""))).alias("l")).select("kind", "key", "l.*")


def verify(records: DataFrame, works: DataFrame, notices: DataFrame, relations: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records ``rec``, ``title``, ``doi``, ``pmid``, ``sources``, ``types``, ``conflicts`` after verification, and issues.

    ``works``: ``key`` (a normalised doi), ``doi``, ``title``, ``type``, ``subtype``, ``updates``, ``relation``. ``notices``: ``target``, ``type``, ``label``.
    ``relations``: ``pmid``, ``ref_type``. ``lookups``: see ``lookup_states``; kinds ``work``, ``updates`` and ``relations``.

    A PMID from its own registry verifies; a DOI whose work has the same DOI and a like title verifies across sources if nothing conflicts; any
    conflict overrides both. A check is complete if each identifier that is there was looked up, so a record without any is complete, and unverified."""
    state = lookup_states(lookups)
    of = lambda kind, key: state.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("answered").alias(f"{kind}_ok"), F.col("error").alias(f"{kind}_error"))
    notice = notices.groupBy(F.col("target").alias("n_key")).agg(F.collect_list(F.struct("type", "label")).alias("notices"))
    related = relations.groupBy(F.col("pmid").alias("r_key")).agg(F.collect_list("ref_type").alias("ref_types"))
    found = works.dropDuplicates(["key"]).select(F.col("key").alias("w_key"), F.col("doi").alias("w_doi"), F.col("title").alias("w_title"), work_signals(F.col("type"), F.col("subtype"), F.col("updates"), F.col("relation")).alias("w_signals"))
    norm = normalize_doi(F.col("doi"))
    r = records.withColumn("key", norm)
    r = r.join(found, F.col("key") == F.col("w_key"), "left").join(of("work", "a"), F.col("key") == F.col("a"), "left").join(of("updates", "b"), F.col("key") == F.col("b"), "left")
    r = r.join(of("relations", "c"), F.col("pmid") == F.col("c"), "left").join(notice, F.col("key") == F.col("n_key"), "left").join(related, F.col("pmid") == F.col("r_key"), "left")

    has_doi, has_pmid = F.col("doi").isNotNull() & (F.col("doi") != ""), F.col("pmid").isNotNull() & (F.col("pmid") != "")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    worked = F.col("w_key").isNotNull() & F.coalesce("work_ok", F.lit(True))
    r = r.withColumns({"worked": worked, "similarity": title_similarity("title", F.coalesce("w_title", F.lit("")))})
    updates_ok = F.col("worked") & yes("updates_ok")
    own = F.when(F.col("worked") & ~normalize_doi(F.col("w_doi")).eqNullSafe(F.col("key")), "doi_mismatch")
    like = F.when(F.col("worked") & (F.col("similarity") < SAME_TITLE), "title_mismatch")
    r = r.withColumn("all_conflicts", F.concat(F.coalesce("conflicts", F.array().cast("array<string>")), F.array_compact(F.array(own, like))))
    registry = has_pmid & F.array_contains("sources", "pubmed")
    clean = F.size("all_conflicts") == 0
    level = (
        F.when(~clean, "metadata_conflict").when(F.col("worked"), "cross_source_verified").when(registry, "authoritative_id_verified")
        .when(has_doi, "unverified").when(has_pmid & F.array_contains("sources", "europe_pmc"), "authoritative_id_verified").otherwise("unverified")
    )
    none = F.array().cast(_SIGNAL)
    signals = F.concat(*(F.coalesce(s, none) for s in (
        F.when(F.col("worked"), F.col("w_signals")), F.when(updates_ok, notice_signals("crossref:update-to", F.col("notices"))), type_signals(F.col("types")),
        F.when(yes("relations_ok"), F.array_compact(F.transform("ref_types", lambda t: signal("pubmed:related_article.ref_type", t)))),
    )))
    complete = (~has_doi | updates_ok) & (~has_pmid | yes("relations_ok"))
    r = r.withColumns({"verification": level, "status": assess(signals), "complete": complete})
    grave = F.col("status.status")
    reasons = F.array_compact(F.array(
        F.when(registry, "pmid_resolved"), F.when(F.col("worked") & clean, "doi_and_title_matched"), F.when(has_doi & ~F.col("worked") & ~registry, "doi_not_resolved"),
        F.when(grave != "unknown", F.concat(F.lit("signal_"), grave)), F.when(~F.col("complete"), "status_check_incomplete"), F.when(~clean, "conflict_blocks"),
        F.when(clean & ~F.col("worked") & ~registry & ~has_doi, F.when(level == "authoritative_id_verified", "pmid_resolved_by_mirror").otherwise("nothing_confirmed")),
    ))
    checked = F.array_compact(F.array(F.when(updates_ok, "crossref_reverse_updates"), F.when(yes("relations_ok"), "pubmed_comments_corrections")))
    verified = F.col("verification").isin("cross_source_verified", "authoritative_id_verified")
    out = r.select("rec", "verification", F.col("all_conflicts").alias("conflicts"), reasons.alias("reasons"), grave.alias("status"), F.col("status.signals").alias("signals"), checked.alias("checked"), "complete", F.when(grave == "retracted", "flagged").otherwise("unknown").alias("flag"), policy.citation_ready(verified, F.size("all_conflicts"), grave == "retracted", grave, F.col("complete")).alias("ready"))
    failed = F.array_compact(F.array(
        F.when(has_doi & F.col("work_error").isNotNull(), F.struct(F.lit("crossref").alias("source"), F.lit("verification").alias("stage"), F.col("work_error").alias("message"))),
        F.when(F.col("worked") & ~updates_ok, F.struct(F.lit("crossref").alias("source"), F.lit("publication_status").alias("stage"), F.coalesce("updates_error", F.lit("not looked up")).alias("message"))),
        F.when(has_pmid & ~yes("relations_ok"), F.struct(F.lit("pubmed").alias("source"), F.lit("publication_status").alias("stage"), F.coalesce("relations_error", F.lit("not looked up")).alias("message"))),
    ))
    issues = r.select("rec", F.explode(failed).alias("i")).select("rec", "i.*", F.lit(False).alias("fatal"))
    return out, issues


def observations(evidence: DataFrame, field: str) -> DataFrame:
    """``rec``, ``field``, ``source``, ``evidence_id``, ``value`` of evidence rows that have the field."""
    return evidence.select("rec", F.lit(field).alias("field"), "source", "evidence_id", F.col(field).cast("string").alias("value")).where("value is not null and value <> ''")


def decide_fields(seen: DataFrame, priority: tuple[str, ...] = ("pubmed", "crossref", "europe_pmc")) -> DataFrame:
    """The observation of each record's field that counts (by source, in order of priority; then by name, evidence and value), the others, and whether they conflict."""
    norm = F.when(F.col("field") == "doi", normalize_doi(F.col("value"))).when(F.col("field") == "title", F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))).otherwise(F.trim(F.col("value")))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0)), F.lit(len(priority) + 1))
    one = F.struct(rank.alias("rank"), "source", "evidence_id", norm.alias("norm"), "value")
    held = seen.groupBy("rec", "field").agg(F.array_sort(F.collect_list(one)).alias("o"))
    plain = F.transform("o", lambda x: F.struct(x["source"].alias("source"), x["evidence_id"].alias("evidence_id"), x["value"].alias("value")))
    return held.select("rec", "field", plain[0].alias("selected"), F.slice(plain, 2, F.size(plain)).alias("alternatives"), (F.size(F.array_distinct(F.transform("o", lambda x: x["norm"]))) > 1).alias("conflict"))


def semantic_errors(records: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """``rec`` and ``error`` of records whose status evidence does not bear out what they claim.

    Records: ``rec``, ``doi``, ``pmid``, ``evidence`` (structs ``evidence_id``, ``source``, ``record_id``, ``doi``, ``pmid``, ``response_sha256``), ``status_ids``,
    ``complete``, ``ready``. ``archived``: ``response_sha256`` of the responses at hand."""
    verifier_doi = lambda c: F.nullif(F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), r"[ .;,)]+$", "")), F.lit(""))
    wanted = F.array_compact(F.array(F.when(F.col("doi").isNotNull() & (F.col("doi") != ""), "crossref_status"), F.when(F.col("pmid").isNotNull() & (F.col("pmid") != ""), "pubmed_status")))
    r = records.withColumns({"wanted": wanted, "ids": F.transform("evidence", lambda e: e["evidence_id"])})
    own = r.select("rec", F.explode(F.array_compact(F.array(
        F.when((F.size(F.array_distinct("ids")) != F.size("ids")) | F.exists("ids", lambda i: i.isNull()), "evidence_ids_not_unique"),
        F.when(F.col("complete") & (F.size("status_ids") != F.size("wanted")), "status_evidence_count"), F.when(F.col("ready") & ~F.col("complete"), "ready_without_complete_check"),
    ))).alias("error"))
    one = r.select("rec", "doi", "pmid", "complete", "wanted", F.explode("status_ids").alias("id"), "evidence").withColumn("e", F.get(F.filter("evidence", lambda x: x["evidence_id"] == F.col("id")), F.lit(0)))
    each = one.select("rec", F.explode(F.array_compact(F.array(
        F.when(F.col("e").isNull(), "status_evidence_unresolved"), F.when(F.col("e").isNotNull() & ~F.coalesce(F.col("e.source").isin("crossref_status", "pubmed_status"), F.lit(False)), "status_evidence_wrong_source"),
        F.when(F.col("e").isNotNull() & ~sha256(F.col("e.response_sha256")), "status_evidence_lacks_digest"),
    ))).alias("error"))
    bound = F.when(F.col("e.source") == "crossref_status", verifier_doi(F.col("e.doi")).eqNullSafe(verifier_doi(F.col("doi"))) & F.col("e.record_id").eqNullSafe(F.col("doi"))).otherwise(F.col("e.pmid").eqNullSafe(F.col("pmid")) & F.col("e.record_id").eqNullSafe(F.col("pmid")))
    per = one.where("complete and e is not null").groupBy("rec", F.col("e.source").alias("source")).agg(F.count("*").alias("n"), F.bool_and(bound).alias("bound"))
    needed = r.where("complete").select("rec", F.explode("wanted").alias("source")).join(per, ["rec", "source"], "left")
    needed = needed.select("rec", F.when(F.coalesce("n", F.lit(0)) != 1, F.concat(F.lit("needs_one_"), "source")).when(~F.col("bound"), F.concat("source", F.lit("_target_differs"))).alias("error")).where("error is not null")
    out = own.unionByName(each).unionByName(needed)
    if archived is not None:
        digests = one.where("e is not null").select("rec", F.col("e.response_sha256").alias("response_sha256")).where(sha256(F.col("response_sha256")))
        out = out.unionByName(digests.join(archived.select("response_sha256").distinct(), "response_sha256", "left_anti").select("rec", F.lit("status_evidence_not_archived").alias("error")))
    return out
