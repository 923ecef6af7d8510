"""What a run leaves: record lines, a manifest, a report, and tables, in a folder that must not be there before."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how many authors a report names.
AUTHORS = 6


def slug(text: str, most: int = 48) -> str:
    return re.sub(r"[^a-zA-Z0-9\u4e00-\u9fff]+", "-", text).strip("-")[:most] or "search"


def run_folder(root: str, started_at: str, query: str) -> str:
    """The folder of a run, by its time (a parameter, so that runs can be repeated) and query."""
    stamp = started_at.replace(":", "").replace("+", "-").split(".")[0]
    return f"{root.rstrip('/')}/{stamp}-{slug(query)}"


def author_line(authors: Column, most: int = AUTHORS) -> Column:
    return F.concat(F.array_join(F.slice(authors, 1, most), ", "), F.when(F.size(authors) > most, ", et al.").otherwise(""))


def record_json(records: DataFrame, *columns: str) -> DataFrame:
    """Records as one JSON object a row, fields without a value included."""
    names = columns or tuple(records.columns)
    return records.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def manifest(records: DataFrame, pagination: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: what a run returned (``ready`` of records), whether anything is ``partial`` (an issue, or a source's state), and whether the search is ``complete`` (sources there are, and all of them complete)."""
    r = records.agg(F.count("*").alias("returned"), F.count_if(F.coalesce("ready", F.lit(False))).alias("citation_ready"))
    p = pagination.agg(F.count("*").alias("sources"), F.coalesce(F.bool_or(F.col("state") == "partial"), F.lit(False)).alias("some_partial"), F.coalesce(F.bool_and(F.col("state") == "complete"), F.lit(False)).alias("all_complete"), F.coalesce(F.sum("total_available"), F.lit(0)).alias("total_available"))
    i = issues.agg(F.count("*").alias("issues"))
    one = r.withColumn("k", F.lit(1)).join(p.withColumn("k", F.lit(1)), "k").join(i.withColumn("k", F.lit(1)), "k")  # a row each
    return one.select("returned", "citation_ready", "sources", "total_available", "issues", (F.col("some_partial") | (F.col("issues") > 0)).alias("partial"), ((F.col("sources") > 0) & F.col("all_complete")).alias("search_complete"))


def report_lines(records: DataFrame) -> DataFrame:
    """``position`` and ``value``: a section of a report for each record (``position``, ``title``, ``authors``, ``journal``, ``year``, ``doi``, ``pmid``, ``verification``, ``ready``, ``status``, ``reasons``, ``conflicts``)."""
    or_none = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("not given"))
    ids = F.concat_ws("; ", F.when(F.col("pmid").isNotNull(), F.concat(F.lit("PMID "), "pmid")), F.when(F.col("doi").isNotNull(), F.concat(F.lit("DOI "), "doi")))
    lines = [
        F.concat(F.lit("### "), F.col("position").cast("string"), F.lit(". "), "title"), F.concat(F.lit("- status: `"), "verification", F.lit("`, ready to cite: "), F.when(F.col("ready"), "yes").otherwise("no")), F.concat(F.lit("- authors: "), F.coalesce(F.nullif(author_line(F.col("authors")), F.lit("")), F.lit("not given"))),
        F.concat(F.lit("- journal, year: "), or_none("journal"), F.lit(", "), or_none("year")), F.concat(F.lit("- identifiers: "), F.coalesce(F.nullif(ids, F.lit("")), F.lit("not given"))), F.concat(F.lit("- after publication: `"), "status", F.lit("`")),
        F.when(F.size("reasons") > 0, F.concat(F.lit("- grounds: "), F.array_join("reasons", ", "))), F.when(F.size("conflicts") > 0, F.concat(F.lit("- conflicts: "), F.array_join("conflicts", " | "))),
    ]
    return records.select("position", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("value"))


def report_head(query: str, row: dict, pagination: list[dict], issues: list[dict]) -> str:
    """The beginning of a report, from the manifest's row, a row a source, and issues."""
    out = [f"# Search: {query}", "", f"- records after deduplication: {row['returned']}", f"- ready to cite: {row['citation_ready']}", f"- partial: {'yes' if row['partial'] else 'no'}", f"- all pages of all sources: {'yes' if row['search_complete'] else 'no'}", "", "Only the sources named were searched. Ready to cite means that identifiers and metadata agree, not that anyone has read the text.", "", "## Sources", ""]
    out += [f"- {p['run']}: {p['total_available']} available, {p['records_returned']} returned, `{p['state']}`" + "".join(f"; {e}" for e in p.get("errors") or ()) for p in sorted(pagination, key=lambda p: p["run"])]
    out += ["", "## Issues", "", *(f"- {i['source']}/{i['stage']}: {i['message']}" for i in issues)] if issues else []
    return "\n".join([*out, "", "## Records", ""])


def write_run(spark: SparkSession, folder: str, query: str, records: DataFrame, pagination: DataFrame, issues: DataFrame) -> DataFrame:
    """Writes records as JSON lines, the report and the manifest (with a digest of each file) to a new folder; returns the digests (``file``, ``sha256``)."""
    record_json(records).write.mode("errorifexists").text(f"{folder}/records")
    row = manifest(records, pagination, issues)
    few = [x.asDict() for x in issues.limit(1000).collect()]  # the report names the first; the manifest counts all
    head = report_head(query, row.first().asDict(), [x.asDict() for x in pagination.collect()], few)  # a row a source
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{folder}/report-head")
    report_lines(records).repartitionByRange("position").sortWithinPartitions("position").select(F.concat("value", F.lit("\n")).alias("value")).write.text(f"{folder}/report")
    digests = file_digests(spark, [f"{folder}/records", f"{folder}/report-head", f"{folder}/report"])
    files = digests.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "sha256")))).alias("output_sha256"))
    row.withColumn("k", F.lit(1)).join(files.withColumn("k", F.lit(1)), "k").drop("k").withColumn("query", F.lit(query)).coalesce(1).write.json(f"{folder}/manifest")
    return digests


def file_digests(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``file`` (its folder and name) and ``sha256`` of the files of some folders."""
    rows = spark.read.format("binaryFile").load(folders).where(~F.col("path").rlike(r"/[._][^/]*$"))
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256")).select(F.concat_ws("/", "folder", "name").alias("file"), "sha256")


def verify_run(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a run against its manifest: ``file`` and ``state`` (ok, changed, missing or unlisted)."""
    from .audit import reconcile

    listed = spark.read.schema("output_sha256 map<string,string>").json(f"{folder}/manifest").select(F.explode("output_sha256").alias("file", "sha256"))
    return reconcile(listed, file_digests(spark, [f"{folder}/records", f"{folder}/report-head", f"{folder}/report"]), "file", "sha256")


def decision_lines(decisions: DataFrame) -> DataFrame:
    """Access decisions as JSON lines."""
    return record_json(decisions)


def curve(rounds: DataFrame) -> DataFrame:
    """The saturation table of an expansion's rounds."""
    return rounds.select("round", "frontier", "new", "new_relevant", "cumulative_relevant")


def prisma_text(counts: dict) -> str:
    return "\n".join(f"- {k.replace('_', ' ')}: {v}" for k, v in counts.items())
