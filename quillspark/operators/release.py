"""Checks before a release: schemas, cross-field rules, redaction, reference cases and versions. Each gives rows of errors; none means it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import parts
from ..functions.validate import ARCHIVE_SECRETS, InvalidInput, forbidden_keys

_KINDS = {"string": "STRING", "integer": "BIGINT|INT|SMALLINT|TINYINT", "boolean": "BOOLEAN", "null": "VOID", "number": "BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*"}
_TEXTS = "array<string>"


def _pointer(root: dict, ref: str) -> dict:
    if not ref.startswith("#/"):
        raise InvalidInput(f"not a reference within the schema: {ref}")
    here = root
    for step in ref[2:].split("/"):
        here = here[step.replace("~1", "/").replace("~0", "~")]
    return here


def schema_errors(v: Column, schema: dict, root: dict | None = None, at: str = "$", depth: int = 0) -> Column:
    """Paths and rules at which a variant breaks a JSON schema, compiled to one expression: references, allOf, if/then/else, const, enum, type, and the bounds of
    objects, arrays, texts and numbers. A value that is not there breaks nothing itself; the object that needs it does."""
    root = root or schema
    if depth > 40:
        raise InvalidInput("a schema that refers to itself cannot be compiled")
    if "$ref" in schema:
        return schema_errors(v, _pointer(root, schema["$ref"]), root, at, depth + 1)
    there = v.isNotNull()
    kind = F.schema_of_variant(v)
    is_ = lambda name: F.coalesce(kind.rlike(f"^({_KINDS[name]})$"), F.lit(False))
    inner = lambda value, sub, where: schema_errors(value, sub, root, where, depth + 1)
    out: list[Column] = []  # one message or null each
    more: list[Column] = []  # arrays of messages
    say = lambda bad, rule: out.append(F.when(there & F.coalesce(bad, F.lit(False)), F.lit(f"{at}: {rule}")))
    json = F.to_json(v)
    literal = lambda x: F.to_json(F.try_parse_json(F.lit(_dump(x))))
    for sub in schema.get("allOf", ()):
        more.append(inner(v, sub, at))
    if "if" in schema:
        holds = F.size(inner(v, schema["if"], at)) == 0
        none = F.array().cast(_TEXTS)
        yes = inner(v, schema["then"], at) if schema.get("then") else none
        no = inner(v, schema["else"], at) if schema.get("else") else none
        more.append(F.when(there & holds, yes).when(there, no).otherwise(none))
    if "const" in schema:
        say(~json.eqNullSafe(literal(schema["const"])), "const")
    if "enum" in schema:
        hit = F.lit(False)
        for x in schema["enum"]:
            hit = hit | json.eqNullSafe(literal(x))
        say(~hit, "enum")
    declared = schema.get("type")
    if declared is not None:
        kinds = [declared] if isinstance(declared, str) else declared
        say(~F.coalesce(kind.rlike(f"^({'|'.join(_KINDS[k] for k in kinds)})$"), F.lit(False)), "type")

    members = F.when(is_("object"), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    say(F.size(members) < schema.get("minProperties", 0), "minProperties")
    if "maxProperties" in schema:
        say(F.size(members) > schema["maxProperties"], "maxProperties")
    for name in schema.get("required", ()):
        say(is_("object") & ~F.array_contains(members, name), f"required {name}")
    properties, additional = schema.get("properties", {}), schema.get("additionalProperties", True)
    for name, sub in properties.items():
        more.append(inner(F.when(is_("object"), F.try_variant_get(v, f"$['{name}']", "variant")), sub, f"{at}.{name}"))
    if additional is False:
        say(F.size(F.array_except(members, F.array(*map(F.lit, properties)).cast(_TEXTS))) > 0, "additionalProperties")
    elif isinstance(additional, dict):
        rest = F.filter(F.map_entries(F.when(is_("object"), F.try_variant_get(v, "$", "map<string,variant>"))), lambda e: ~e["key"].isin(*properties) if properties else F.lit(True))
        more.append(F.flatten(F.coalesce(F.transform(rest, lambda e: inner(e["value"], additional, f"{at}.*")), F.array().cast(f"array<{_TEXTS}>"))))

    items = F.when(is_("array"), F.try_variant_get(v, "$", "array<variant>"))
    say(F.size(items) < schema.get("minItems", 0), "minItems")
    if "maxItems" in schema:
        say(F.size(items) > schema["maxItems"], "maxItems")
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda x: F.coalesce(F.to_json(x), F.lit("null")))
        say(F.size(F.array_distinct(texts)) != F.size(texts), "uniqueItems")
    if isinstance(schema.get("items"), dict):
        more.append(F.flatten(F.coalesce(F.transform(items, lambda x: inner(x, schema["items"], f"{at}[]")), F.array().cast(f"array<{_TEXTS}>"))))

    text = F.when(is_("string"), F.try_variant_get(v, "$", "string"))
    say(F.length(text) < schema.get("minLength", 0), "minLength")
    if "maxLength" in schema:
        say(F.length(text) > schema["maxLength"], "maxLength")
    if "pattern" in schema:
        say(~text.rlike(schema["pattern"]), "pattern")
    if schema.get("format") == "date-time":
        say(F.when(text.isNotNull(), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).isNull()), "date-time")
    number = F.when(is_("number"), F.try_variant_get(v, "$", "double"))
    if "minimum" in schema:
        say(number < schema["minimum"], "minimum")
    if "maximum" in schema:
        say(number > schema["maximum"], "maximum")
    own = F.array_compact(F.array(*out)).cast(_TEXTS) if out else F.array().cast(_TEXTS)
    return F.concat(own, *more) if more else own


def _dump(x: object) -> str:
    import json

    return json.dumps(x, ensure_ascii=False)


def validate(rows: DataFrame, body: str, schema: dict) -> DataFrame:
    """``rows`` with ``errors`` of the JSON in ``body``; what is not JSON has the error ``unreadable``."""
    v = F.try_parse_json(body)
    return rows.withColumn("v_", v).withColumn("errors", F.when(F.col("v_").isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_distinct(schema_errors(F.col("v_"), schema)))).drop("v_")


def redaction_errors(metadata: DataFrame) -> DataFrame:
    """``rows`` of archived metadata (``name``, ``body``) and what in them should not be there: names of members, headers and query parameters that identify a caller, and a request without an address."""
    v = F.try_parse_json("body")
    url = F.try_variant_get(v, "$.request.url", "string")
    headers = F.map_keys(F.try_variant_get(v, "$.request.headers", "map<string,variant>"))
    query = F.transform(F.filter(F.split(parts(url)["query"], "&"), lambda p: p != ""), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))))
    found = F.concat(
        F.transform(F.coalesce(forbidden_keys(F.col("body"), ARCHIVE_SECRETS, whole=True), F.array(F.lit("unreadable"))), lambda k: F.concat(F.lit("member "), F.lower(k))),
        F.coalesce(F.transform(F.filter(headers, lambda h: F.lower(h).rlike("email|key|token")), lambda h: F.concat(F.lit("header "), F.lower(h))), F.array().cast(_TEXTS)),
        F.coalesce(F.transform(F.filter(query, lambda k: k.isin(*ARCHIVE_SECRETS)), lambda k: F.concat(F.lit("parameter "), k)), F.array().cast(_TEXTS)),
        F.when(v.isNotNull() & url.isNull(), F.array(F.lit("address missing"))).otherwise(F.array().cast(_TEXTS)),
    )
    return metadata.select("name", F.explode(F.array_distinct(found)).alias("error"))


_COUNTS = ("reference_count", "cited_reference_count", "citation_occurrence_count", "lookup_attempted_count", "high_confidence_match_count", "lookup_completed_count", "lookup_partial_count", "lookup_failed_count")
_BATCH = ("selected_count", "attempted_this_run", "completed_count", "partial_count", "failed_count", "pending_count")
MANIFEST = (
    "source_pdf struct<name:string,page_count:int>, derivation struct<page_text_sha256:array<string>>, lookup_policy struct<lookup_enabled:boolean,transport_mode:string,sources:array<string>,selected_reference_numbers:array<int>,checkpoint_sha256:string,cache_enabled:boolean>, "
    f"lookup_batch struct<batch_status:string,{','.join(f'{c}:long' for c in _BATCH)}>, summary struct<{','.join(f'{c}:long' for c in _COUNTS)}>, output_sha256 map<string,string>"
)


def audit_manifest_errors(manifests: DataFrame) -> DataFrame:
    """``name`` and ``error`` of audit manifests (``name``, ``body``): rules between fields that a schema cannot state."""
    m = manifests.select("name", F.from_json("body", MANIFEST).alias("m")).select("name", "m.*")
    c = F.col
    s, b, p = (lambda n: c(f"summary.{n}")), (lambda n: c(f"lookup_batch.{n}")), (lambda n: c(f"lookup_policy.{n}"))
    on, off, none = p("lookup_enabled"), ~p("lookup_enabled"), lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    has = lambda k: F.array_contains(F.map_keys("output_sha256"), k)
    ended = s("lookup_completed_count") + s("lookup_partial_count") + s("lookup_failed_count")
    sorted_ = b("completed_count") + b("partial_count") + b("failed_count") + b("pending_count")
    status = F.when(b("completed_count") == b("selected_count"), "completed").when(b("pending_count") == b("selected_count"), "pending").when(b("failed_count") == b("selected_count"), "failed").otherwise("partial")
    batch = c("lookup_batch").isNotNull()
    rules = {
        "section missing": c("source_pdf").isNull() | c("derivation").isNull() | c("lookup_policy").isNull() | c("summary").isNull() | c("output_sha256").isNull(), "source name has a path": c("source_pdf.name").isNull() | c("source_pdf.name").rlike(r"[/\\]"),
        "page digests": F.size("derivation.page_text_sha256") != c("source_pdf.page_count"), "outputs missing": ~(has("reference_results.jsonl") & has("citation_map.json") & has("report.md")),
        "lookup without batch": on & ~batch, "lookup without source": on & none(p("sources")), "lookup without selection": on & none(p("selected_reference_numbers")), "transport": on & ~F.coalesce(p("transport_mode").isin("network", "offline_replay"), F.lit(False)),
        "replay without cache": on & (p("transport_mode") == "offline_replay") & ~F.coalesce(p("cache_enabled"), F.lit(False)), "checkpoint digest": on & (p("checkpoint_sha256").isNull() | ~p("checkpoint_sha256").eqNullSafe(F.element_at("output_sha256", F.lit("batch_checkpoint.jsonl")))),
        "batch without lookup": off & batch, "policy without lookup": off & (~p("transport_mode").eqNullSafe(F.lit("none")) | ~none(p("sources")) | ~none(p("selected_reference_numbers"))), "checkpoint without lookup": off & (p("checkpoint_sha256").isNotNull() | has("batch_checkpoint.jsonl")),
        "cited exceed references": s("cited_reference_count") > s("reference_count"), "attempted differ from ended": s("lookup_attempted_count") != ended, "matches exceed attempts": s("high_confidence_match_count") > s("lookup_attempted_count"),
        "attempts exceed selection": s("lookup_attempted_count") > F.size(p("selected_reference_numbers")), "attempts without lookup": off & (s("lookup_attempted_count") != 0), "batch selection": batch & (b("selected_count") != F.size(p("selected_reference_numbers"))), "batch counts": batch & (sorted_ != b("selected_count")),
        "batch attempts": batch & (b("attempted_this_run") > b("selected_count")), "batch completed": batch & (s("lookup_completed_count") != b("completed_count")), "batch partial": batch & (s("lookup_partial_count") != b("partial_count")), "batch failed": batch & (s("lookup_failed_count") != b("failed_count")),
        "batch status": batch & ~b("batch_status").eqNullSafe(status),
    }
    return m.select("name", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), rule) for rule, bad in rules.items())))).alias("error"))


#: Kinds of adversarial cases, and how many of each.
CATEGORIES, EACH = ("retraction", "correction", "expression_of_concern", "metadata_conflict", "missing_identifier", "truncated_lookup", "license_unknown", "duplicate_record"), 30


def synthetic_cases(spark: SparkSession) -> DataFrame:
    """Cases made by rule, which claim no human judgement: ``EACH`` of each category."""
    names = F.array(*map(F.lit, CATEGORIES))
    kind = F.get(names, F.col("id") % len(CATEGORIES))
    rows = spark.range(len(CATEGORIES) * EACH).withColumns({"category": kind, "scenario_variant": F.floor(F.col("id") / len(CATEGORIES)).cast("int") + 1})
    status = F.when(F.col("category") == "retraction", "retracted").when(F.col("category").isin("correction", "expression_of_concern"), F.col("category")).otherwise("unknown")
    return rows.select(F.format_string("%s-%03d", "category", "scenario_variant").alias("case_id"), "category", "scenario_variant", status.alias("expected_publication_status"), (F.col("category") == "duplicate_record").alias("expected_citation_ready"), F.lit(True).alias("critical"), F.lit("synthetic_contract_v1").alias("label_source"), F.lit(False).alias("human_adjudicated"))


def case_errors(cases: DataFrame, least: int = 200, categories: int = 8) -> DataFrame:
    """``case_id`` and ``error`` of a set of synthetic cases that is too small or narrow, repeats an id, or claims what it is not."""
    n = cases.groupBy("case_id").count()
    each = cases.select("case_id", F.explode(F.array_compact(F.array(F.when(F.coalesce("case_id", F.lit("")) == "", "id_missing"), F.when(~F.col("label_source").eqNullSafe(F.lit("synthetic_contract_v1")), "label_source"), F.when(~F.col("human_adjudicated").eqNullSafe(F.lit(False)), "human_adjudicated")))).alias("error"))
    whole = cases.agg(F.count("*").alias("n"), F.count_distinct("category").alias("k")).select(F.lit(None).cast("string").alias("case_id"), F.explode(F.array_compact(F.array(F.when(F.col("n") < least, "too_few"), F.when(F.col("k") < categories, "too_narrow")))).alias("error"))
    return each.unionByName(n.where("count > 1 and case_id is not null").select("case_id", F.lit("id_repeated").alias("error"))).unionByName(whole)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Reference cases from a file that holds a JSON array; raises if an id is missing or repeated."""
    schema = "case_id string, category string, expected_publication_status string, expected_citation_ready boolean, critical boolean, scenario_variant int, label_source string, human_adjudicated boolean"
    cases = spark.read.schema(schema).json(path, multiLine=True)
    if cases.isEmpty() or not cases.groupBy("case_id").count().where("count > 1 or case_id is null or case_id = ''").isEmpty():
        raise InvalidInput("cases need an id each, and at least one case")
    return cases


def gate(metrics: DataFrame) -> Column:
    """Whether a row of counts (``cases``, ``missing``, ``unexpected``, ``mismatches``, ``false_positives``, ``false_negatives``) lets a release pass: cases, and no fault of any kind."""
    return F.coalesce((F.col("cases") > 0) & (F.col("missing") + F.col("unexpected") + F.col("mismatches") + F.col("false_positives") + F.col("false_negatives") == 0), F.lit(False))


def version_errors(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``name`` and ``error`` of files (``name``, ``value``) whose declared version, found by the pattern for their name, is missing or is not the one that most files have."""
    found = None
    for name, pattern in patterns.items():
        rows = files.where(F.col("name") == name).select("name", F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("version"))
        found = rows if found is None else found.unionByName(rows)
    common = found.where("version is not null").groupBy("version").count().agg(F.max_by("version", F.struct("count", "version")).alias("common"))
    one = common.first()["common"]
    return found.select("name", F.when(F.col("version").isNull(), "version missing").when(F.col("version") != F.lit(one), "version differs").alias("error")).where("error is not null")


def release_errors(**checks: DataFrame) -> DataFrame:
    """Errors of all checks, each with the ``check`` that found it; an empty result lets a release pass."""
    out = None
    for name, rows in checks.items():
        one = rows.select(F.lit(name).alias("check"), F.col(rows.columns[0]).cast("string").alias("subject"), F.col("error"))
        out = one if out is None else out.unionByName(one)
    return out
