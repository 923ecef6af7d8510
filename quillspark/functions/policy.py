"""Closed vocabularies and row decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import parts, safe_http

#: Labels of post-publication notices.
RETRACTED = ("retracted publication", "retraction of publication", "retraction", "retracted", "retractionin", "retractionof", "is retracted by", "is retraction of")
CORRECTION = ("published erratum", "corrected and republished article", "correction", "corrigendum", "erratum", "erratumin", "erratumfor", "republishedin", "republishedfrom", "update", "is corrected by", "is correction of")
CONCERN = ("expression of concern", "expressionofconcernin", "expressionofconcernfor", "is expression of concern of", "is concerned by")
#: Status by severity, the least first.
SEVERITY = ("unknown", "correction", "expression_of_concern", "retracted")
#: Licences under which texts may be read by machine.
MACHINE_READABLE = ("cc by", "cc by 1.0", "cc by 2.0", "cc by 2.5", "cc by 3.0", "cc by 4.0", "cc by sa", "cc by sa 1.0", "cc by sa 2.0", "cc by sa 2.5", "cc by sa 3.0", "cc by sa 4.0", "cc0", "cc0 1.0", "public domain")
#: Words for the versions of a manuscript, without separators.
POLICY_VERSIONS = {"submitted": ("submitted", "submittedversion", "preprint"), "accepted": ("accepted", "acceptedversion", "acceptedmanuscript"), "published": ("published", "publishedversion", "versionofrecord")}
CANDIDATE_VERSIONS = {"publishedVersion": ("vor", "versionofrecord", "published", "publishedversion"), "acceptedVersion": ("am", "accepted", "acceptedmanuscript", "acceptedversion"), "submittedVersion": ("sm", "submitted", "submittedversion", "preprint")}


def classify_label(c: Column) -> Column:
    """The status that a notice's label stands for, or null; separators and case do not matter."""
    spaced = F.regexp_replace(F.lower(F.trim(c)), r"[_\-\s]+", " ")
    tight = F.replace(spaced, F.lit(" "), F.lit(""))
    either = lambda words: spaced.isin(*words) | tight.isin(*words)
    return F.when(either(RETRACTED), "retracted").when(either(CONCERN), "expression_of_concern").when(either(CORRECTION), "correction")


def classify_crossmark(c: Column) -> Column:
    """The wider vocabulary of update registries."""
    word = F.regexp_replace(F.lower(F.trim(c)), r"[-_\s]+", "_")
    return F.when(word.isin("retraction", "retracted", "partial_retraction", "withdrawal", "removal"), "retracted").when(word.isin("correction", "corrigendum", "erratum"), "correction").when(word == "expression_of_concern", "expression_of_concern")


def severity(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), status) - 1, F.lit(0)).cast("int")


def status_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITY)), rank + 1)


def citation_ready(verified: Column, conflicts: Column, flagged: Column, status: Column, checked: Column) -> Column:
    """Fails closed: an unknown input is not ready."""
    return F.coalesce(verified & (conflicts == 0) & ~flagged & (status == "unknown") & checked, F.lit(False))


def normalize_license(c: Column) -> Column:
    value = F.lower(F.trim(c))
    p = parts(value)
    seg = F.filter(F.split(p["path"], "/"), lambda x: x != "")
    cc = p["scheme"].isin("http", "https") & p["host"].isin("creativecommons.org", "www.creativecommons.org") & (p["port"] == "")
    zero = cc & (F.get(seg, F.lit(0)) == "publicdomain") & (F.get(seg, F.lit(1)) == "zero")
    by = cc & (F.get(seg, F.lit(0)) == "licenses") & (F.size(seg) >= 3)
    plain = F.trim(F.regexp_replace(F.replace(F.regexp_replace(value, r"[_\-/\s]+", " "), F.lit("creative commons"), F.lit("cc")), " +", " "))
    return (
        F.when(value == "", None).when(value.isin("implied", "unknown", "none", "null", "unspecified"), value)
        .when(zero, F.concat(F.lit("cc0 "), F.coalesce(F.get(seg, F.lit(2)), F.lit("1.0"))))
        .when(by, F.concat_ws(" ", F.lit("cc"), F.replace(F.get(seg, F.lit(1)), F.lit("-"), F.lit(" ")), F.get(seg, F.lit(2))))
        .otherwise(plain)
    )


def _lookup(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in table.items():
        out = F.when(value.isin(*words), name).otherwise(out)
    return out


def policy_version(c: Column) -> Column:
    return F.coalesce(_lookup(F.regexp_replace(F.lower(F.trim(c)), r"[_\-\s]+", ""), POLICY_VERSIONS), F.lit("unknown"))


def candidate_version(c: Column) -> Column:
    return _lookup(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), CANDIDATE_VERSIONS)


def assess_license(url: Column, license: Column) -> Column:
    """allowed_machine_read, restricted_link_only or unknown."""
    norm = normalize_license(license)
    unclear = norm.isNull() | norm.isin("implied", "unknown", "none", "null", "unspecified")
    return F.when(unclear | ~safe_http(F.coalesce(url, F.lit(""))), "unknown").when(norm.isin(*MACHINE_READABLE), "allowed_machine_read").otherwise("restricted_link_only")


def oa_triage(doi: Column, pmid: Column, pmcid: Column, is_open: Column, own_license: Column, location_url: Column, location_license: Column) -> tuple[Column, Column]:
    """Category and route of lawful access: the subset with its own licence first, then the best open location."""
    first = pmcid.isNotNull() & F.coalesce(is_open, F.lit(False))
    own_ok = first & (assess_license(F.lit("https://archive.example.org/x"), own_license) == "allowed_machine_read")
    second = doi.isNotNull() & location_url.isNotNull()
    second_ok = second & (assess_license(location_url, location_license) == "allowed_machine_read")
    category = F.when(own_ok | second_ok, "oa_machine_readable").when(first | second, "oa_link_only").when(doi.isNotNull() | pmid.isNotNull(), "needs_institutional_access").otherwise("no_identifier")
    route = F.when(own_ok, "subset").when(second_ok, "location").when(first, "subset").when(second, "location")
    return category, route


def weighted_score(parts_: list[tuple[float, Column]]) -> Column:
    """Mean over the components that are known."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in parts_), F.lit(0.0))
    return sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts_), F.lit(0.0)) / total


#: Scores from which a candidate is a sure match, or one to review; and those of journals that speak for or against it.
SURE, SURE_TITLE, REVIEW, JOURNAL_FOR, JOURNAL_AGAINST, BACKING = 0.86, 0.88, 0.72, 0.80, 0.25, 2


def match_decision(score: Column, title: Column, author: Column, year: Column, journal: Column, doi: Column) -> Column:
    """What a candidate is to a reference; author and year scores are 0, 1 or null."""
    no = lambda c: F.coalesce(c == 0, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    backing = yes(author == 1) + yes(year == 1) + yes(journal >= JOURNAL_FOR)
    against = no(author) | no(year) | F.coalesce(journal < JOURNAL_AGAINST, F.lit(False))
    return (
        F.when(doi & ((title < REVIEW) | no(author) | no(year)), "identifier_metadata_conflict")
        .when(doi | ((score >= SURE) & (title >= SURE_TITLE) & (backing >= BACKING) & ~against), "matched_high_confidence")
        .when((score >= REVIEW) & (title >= REVIEW), "candidate_requires_review").otherwise("not_matched")
    )
