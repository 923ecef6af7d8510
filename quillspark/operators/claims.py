"""Claims bound to places in texts, and the attestations of those who read them. A place found is not a claim supported."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import GENESIS, canonical_json
from ..functions.text import paragraphs, quote_count
from ..functions.validate import sha256

#: What a binding may ask for, and the parts an article must have.
SUPPORT = ("SUPPORTED", "AMBIGUOUS", "UNSUPPORTED", "UNVERIFIABLE_ACCESS")
ARTICLE_PARTS = {"front", "article-meta", "title-group", "article-title", "body"}
ATTESTED, RESCINDED = "HUMAN_READ_SELF_ATTESTED", "HUMAN_READ_RESCINDED"
RANGE = r"^([1-9][0-9]*)(?:-([1-9][0-9]*))?$"


def locate(kind: Column, value: Column, text: Column, pages: Column | None = None, sections: Column | None = None) -> Column:
    """``status`` (located, not_found, ambiguous, invalid_anchor, out_of_bounds) and ``excerpt`` of an anchor: a quote that occurs once, a section by
    its label (``sections``: a map), or a range of pages or paragraphs, from 1, both ends included."""
    none = F.lit(None).cast("string")
    n_quotes = quote_count(text, value)
    low, high = F.regexp_extract(value, RANGE, 1).try_cast("int"), F.regexp_extract(value, RANGE, 2).try_cast("int")
    end = F.coalesce(high, low)

    def picked(parts: Column, by: str) -> tuple[Column, Column]:
        status = F.when(low.isNull() | (end < low), "invalid_anchor").when(end > F.size(parts), "out_of_bounds").otherwise("located")
        return status, F.when(status == "located", F.array_join(F.slice(parts, F.greatest(low, F.lit(1)), F.greatest(end - low + 1, F.lit(0))), by))

    of_paragraph = picked(paragraphs(text), "\n\n")
    of_page = picked(pages, "\n\f\n") if pages is not None else (F.lit("invalid_anchor"), none)
    if pages is not None:
        of_page = (F.when(pages.isNull(), "invalid_anchor").otherwise(of_page[0]), of_page[1])
    section = sections[value] if sections is not None else none
    of_section = F.when(F.lit(sections is None) | (sections.isNull() if sections is not None else F.lit(True)), "invalid_anchor").when(section.isNull(), "not_found").otherwise("located")
    of_quote = F.when(n_quotes == 0, "not_found").when(n_quotes == 1, "located").otherwise("ambiguous")
    bad = F.coalesce(value == "", F.lit(True)) | text.isNull()
    status = F.when(bad, "invalid_anchor").when(kind == "quote", of_quote).when(kind == "section", of_section).when(kind == "page", of_page[0]).when(kind == "paragraph", of_paragraph[0]).otherwise("invalid_anchor")
    excerpt = F.when(kind == "quote", value).when(kind == "section", section).when(kind == "page", of_page[1]).when(kind == "paragraph", of_paragraph[1])
    return F.struct(status.alias("status"), F.when(status == "located", excerpt).alias("excerpt"))


def _article(raw: bytes | None) -> tuple[str | None, str | None]:
    """Text of an article in XML, in document order, or why it is refused."""
    if raw is None:
        return None, "missing"
    if b"<!DOCTYPE" in raw.upper() or b"<!ENTITY" in raw.upper():
        return None, "declarations"
    try:
        root = ET.fromstring(raw)  # noqa: S314  without declarations there is nothing to expand
    except ET.ParseError:
        return None, "not_well_formed"
    space, _, name = root.tag.rpartition("}")
    if name.casefold() not in ("article", "pmc-articleset"):
        return None, "container"
    at = urlsplit(space[1:])
    if space and (at.scheme not in ("http", "https") or at.hostname != "jats.nlm.nih.gov"):
        return None, "namespace"
    if not {n.tag.rpartition("}")[2].casefold() for n in root.iter() if isinstance(n.tag, str)} >= ARTICLE_PARTS:
        return None, "structure"
    return "\n".join(t.strip() for t in root.itertext() if t.strip()), None


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def article_text(raw: pd.Series) -> pd.DataFrame:
    """``text`` and ``error`` of articles in XML; no built-in walks the texts of a tree in order."""
    return pd.DataFrame([_article(r) for r in raw], columns=["text", "error"])


def material_text(rows: DataFrame) -> DataFrame:
    """``rows`` (``material``, ``content_type``) with the ``derived`` text of the bytes and ``derive_error``: plain UTF-8 as it is, articles in XML as their texts."""
    base = F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1))))
    plain = F.try_validate_utf8(F.col("material").cast("string"))
    xml = base.isin("application/xml", "text/xml") | base.endswith("+xml")
    r = rows.withColumn("x", article_text(F.when(xml, F.col("material"))))
    derived = F.when(base == "text/plain", plain).when(xml, F.col("x.text"))
    error = F.when(base == "text/plain", F.when(plain.isNull(), "not_utf8")).when(xml, F.col("x.error")).otherwise("content_type")
    return r.withColumns({"derived": derived, "derive_error": error}).drop("x")


def log_events(lines: DataFrame) -> DataFrame:
    """Events of logs of one JSON object a line (``log``, ``line`` from 1, ``value``), each with the first rule that it breaks (``failure``).

    An event must be an object, follow the event before it by its hash, carry its own hash (over its canonical JSON without it) and be a known type of a
    claimed, unverified human. Of a log, what comes after its first failure does not count (``valid`` is false from there on)."""
    v = F.col("v")
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    rows = lines.withColumn("v", F.try_parse_json("value"))
    w = Window.partitionBy("log").orderBy("line")
    own = get("event_hash")
    rows = rows.withColumns({"event_hash": own, "before": F.lag(own, 1, GENESIS).over(w)})
    canonical = canonical_json(F.col("value"))
    # members are in order, so the member of the hash, wherever it stands, leaves the others as they are
    unhashed = F.regexp_replace(F.regexp_replace(canonical, r'"event_hash":"[^"]*",', ""), r',"event_hash":"[^"]*"', "")
    failure = (
        F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "blank_line").when(v.isNull(), "invalid_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")
        .when(~get("previous_event_hash").eqNullSafe(F.col("before")), "previous_hash").when(~F.col("event_hash").eqNullSafe(F.sha2(unhashed, 256)), "event_hash")
        .when(~F.coalesce(get("event_type").isin(ATTESTED, RESCINDED), F.lit(False)), "event_type").when(~get("actor_type").eqNullSafe(F.lit("claimed_human")), "actor_type")
        .when(~get("attestation_method").eqNullSafe(F.lit("unverified_cli_claim")) | ~F.try_variant_get(v, "$.identity_verified", "boolean").eqNullSafe(F.lit(False)), "identity_claim")
    )
    rows = rows.withColumn("failure", failure)
    broken = F.min(F.when(F.col("failure").isNotNull(), F.col("line"))).over(Window.partitionBy("log"))
    return rows.select("log", "line", "event_hash", get("event_type").alias("event_type"), get("target_event_hash").alias("target_event_hash"), get("material_sha256").alias("material_sha256"), "failure", (broken.isNull() | (F.col("line") < broken)).alias("valid"))


def verify_logs(lines: DataFrame) -> DataFrame:
    """``log``, ``valid``, ``events`` (up to the first failure), ``failed_line`` and ``failure``."""
    first = F.min(F.when(F.col("failure").isNotNull(), F.struct("line", "failure")))
    return log_events(lines).groupBy("log").agg(F.count_if("valid").alias("events"), first.alias("f")).select("log", F.col("f").isNull().alias("valid"), "events", F.col("f.line").alias("failed_line"), F.col("f.failure").alias("failure"))


def attestations(lines: DataFrame) -> DataFrame:
    """``log``, ``event_hash``, ``material_sha256`` and ``standing`` (attested or rescinded) of each attestation in a log that verifies."""
    e = log_events(lines)
    e = e.join(e.groupBy("log").agg(F.bool_and("valid").alias("whole")), "log").where("whole")
    gone = e.where(F.col("event_type") == RESCINDED).select("log", F.col("target_event_hash").alias("event_hash"), F.lit(True).alias("gone")).distinct()
    return e.where(F.col("event_type") == ATTESTED).join(gone, ["log", "event_hash"], "left").select("log", "event_hash", "material_sha256", F.when(F.col("gone"), "rescinded").otherwise("attested").alias("standing"))


def bind(claims: DataFrame, attested: DataFrame | None = None) -> DataFrame:
    """Claims ``claim_id``, ``claim_text``, ``material``, ``content_type``, ``expected_sha256``, ``evidence_id``, ``anchor_kind``, ``anchor_value``, ``text``, ``support``
    (and ``expected_excerpt_sha256``, ``attestation_log``, ``attestation_hash``) as bindings; ``rejected`` says why one cannot be made.

    The material must be the one expected, the text its deterministic extraction, and the anchor a quote or paragraphs that are found. Support that is asked
    for stays ambiguous; an attestation counts if it stands and is of this material, and never verifies an identity."""
    opt = lambda c: F.col(c) if c in claims.columns else F.lit(None).cast("string")
    r = material_text(claims).withColumn("at", locate(F.col("anchor_kind"), F.col("anchor_value"), F.col("text")))
    digest = F.sha2("material", 256)
    if attested is None:
        r = r.withColumns({"standing": F.lit(None).cast("string"), "attested_sha256": F.lit(None).cast("string")})
    else:
        known = attested.select(F.col("log").alias("a_log"), F.col("event_hash").alias("a_hash"), "standing", F.col("material_sha256").alias("attested_sha256"))
        r = r.join(known, (opt("attestation_log") == F.col("a_log")) & (F.lower(F.trim(opt("attestation_hash"))) == F.col("a_hash")), "left")
    asked = opt("attestation_log").isNotNull() | opt("attestation_hash").isNotNull()
    excerpt = F.sha2(F.col("at.excerpt"), 256)
    wanted = F.lower(F.trim(opt("expected_excerpt_sha256")))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rejected = (
        F.when(no(F.col("claim_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$")), "claim_id").when(no(F.trim("claim_text") != ""), "claim_text").when(F.col("material").isNull(), "material")
        .when(~sha256(F.lower(F.trim("expected_sha256"))) | no(F.lower(F.trim("expected_sha256")) == digest), "material_sha256").when(F.col("derive_error").isNotNull(), F.concat(F.lit("material_"), F.col("derive_error")))
        .when(no(F.col("text") == F.col("derived")), "text").when(no(F.col("evidence_id").rlike("^ev-[0-9a-f]{20}$")), "evidence_id").when(no(F.col("anchor_kind").isin("quote", "paragraph")), "anchor_kind")
        .when(no(F.col("support").isin(*SUPPORT)), "support").when(F.col("at.status") != "located", F.concat(F.lit("locator_"), F.col("at.status"))).when(wanted.isNotNull() & no(wanted == excerpt), "excerpt_sha256")
        .when(asked & (opt("attestation_log").isNull() | opt("attestation_hash").isNull()), "attestation_incomplete").when(asked & F.col("standing").isNull(), "attestation_unknown")
        .when(asked & (F.col("standing") == "rescinded"), "attestation_rescinded").when(asked & no(F.col("attested_sha256") == digest), "attestation_material")
    )
    r = r.withColumns({"rejected": rejected, "material_sha256": digest, "excerpt_sha256": excerpt})
    made = F.col("rejected").isNull()
    only = lambda c: F.when(made, c)
    return r.select(
        "claim_id", "rejected", only(F.sha2("claim_text", 256)).alias("claim_text_sha256"), only(F.col("material_sha256")).alias("material_sha256"), "evidence_id", "anchor_kind", "anchor_value", only(F.col("excerpt_sha256")).alias("excerpt_sha256"),
        F.col("at.status").alias("locator"), F.col("support").alias("requested_support"), only(F.when(F.col("support") == "SUPPORTED", "AMBIGUOUS").otherwise(F.col("support"))).alias("support"),
        only(F.when(asked, "SELF_ATTESTED").otherwise("NOT_ATTESTED")).alias("human_review"), F.lit(False).alias("identity_verified"),
    )


#: The members of a review packet.
_PACKET_TEXTS = ("confirmation_statement", "event_type", "identity_claim", "issued_at", "material_sha256", "packet_sha256", "reviewer_role")
PACKET = T.StructType([T.StructField("claim_evidence_ids", T.ArrayType(T.StringType())), *(T.StructField(c, T.StringType()) for c in _PACKET_TEXTS), T.StructField("schema_version", T.IntegerType())])
_REQUEST = "HUMAN_READ_EXTERNAL_SIGNATURE_REQUEST"


def review_packets(rows: DataFrame) -> DataFrame:
    """Packets, as canonical JSON with their own digest, of ``material``, ``reviewer_role``, ``confirmation_statement``, ``issued_at``; null where the role is not anonymous or the statement is short."""
    statement = F.trim(F.regexp_replace("confirmation_statement", r"\s+", " "))
    role = F.lower(F.trim("reviewer_role"))
    body = lambda *more: F.to_json(F.struct(F.array().cast("array<string>").alias("claim_evidence_ids"), statement.alias("confirmation_statement"), F.lit(_REQUEST).alias("event_type"), F.lit("unverified_key_holder").alias("identity_claim"), "issued_at", F.sha2("material", 256).alias("material_sha256"), *more, role.alias("reviewer_role"), F.lit(1).alias("schema_version")))
    ok = role.rlike(r"^anonymous_[a-z0-9]+(_[a-z0-9]+)*$") & (F.length(statement) >= 20) & F.col("material").isNotNull()
    return rows.withColumn("packet", F.when(ok, body(F.sha2(body(), 256).alias("packet_sha256"))))


def packet_error(packet: Column, material: Column | None = None) -> Column:
    """Why a review packet is refused, or null. With ``material``, its digest must be the packet's too."""
    p = F.from_json(packet, PACKET)
    names = F.array_sort(F.map_keys(F.from_json(packet, "map<string,string>")))
    unsigned = F.regexp_replace(canonical_json(packet), r'"packet_sha256":"[^"]*",', "")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    time = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    out = (
        F.when(no(names == F.array(*map(F.lit, sorted(PACKET.names)))), "keys").when(no((p["schema_version"] == 1) & (p["event_type"] == _REQUEST)), "version").when(no(p["identity_claim"] == "unverified_key_holder"), "identity_claim")
        .when(no(p["reviewer_role"].rlike(r"^anonymous_[a-z0-9]+(_[a-z0-9]+)*$")), "reviewer_role").when(~sha256(p["material_sha256"]), "material_sha256").when(no(p["issued_at"].rlike(time)), "issued_at")
        .when(no(F.size(p["claim_evidence_ids"]) == 0), "claim_evidence_ids").when(no((F.length(p["confirmation_statement"]) >= 20) & (p["confirmation_statement"] == F.trim(F.regexp_replace(p["confirmation_statement"], r"\s+", " ")))), "confirmation_statement")
        .when(~p["packet_sha256"].eqNullSafe(F.sha2(unsigned, 256)), "packet_sha256")
    )
    return out if material is None else F.coalesce(out, F.when(~F.sha2(material, 256).eqNullSafe(p["material_sha256"]), "material"))
