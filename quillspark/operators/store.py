"""Stores of responses as append-only tables: bodies by digest, requests by key, records of responses, attempts and checkpoints.

A folder has one parquet table for each; ``version`` guards the layout. Appends never touch what is there; that nothing was changed is what ``integrity`` checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical, redact, request_key
from ..functions.validate import IntegrityError

VERSION = 1
SCHEMAS = {
    "requests": "request_key string, method string, url string, accept string, created_at string",
    "blobs": "sha256 string, body binary, byte_length long",
    "responses": "response_id long, request_key string, sha256 string, status int, fetched_at string, source string, etag string, last_modified string",
    "attempts": "attempt_id string, request_key string, started_at string, outcome string, detail string",
    "checkpoints": "attempt_id string, position long, state string, recorded_at string",
    "version": "version int",
}
#: Headers that an archive leaves out.
SECRET_HEADERS = ("authorization", "cookie", "proxy-authorization", "set-cookie", "user-agent")


def create(spark: SparkSession, path: str) -> None:
    """An empty store; an existing one is left alone."""
    for name, schema in SCHEMAS.items():
        rows = [(VERSION,)] if name == "version" else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("ignore").parquet(f"{path}/{name}")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a store; raises if the store has another layout."""
    found = [r.version for r in spark.read.schema(SCHEMAS["version"]).parquet(f"{path}/version").limit(2).collect()]
    if found != [VERSION]:
        raise IntegrityError(f"a store of version {found}, not {VERSION}")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def safe_headers(headers: Column) -> Column:
    """A map of headers without those that identify a caller."""
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*SECRET_HEADERS) & ~F.lower(k).rlike("email|key|token"))


def archive_rows(responses: DataFrame) -> DataFrame:
    """Responses (``method``, ``url``, ``headers``, ``status``, ``fetched_at``, ``body``) as they are archived: named by time and digest, without what identifies the caller."""
    digest = F.sha2("body", 256)
    stamp = F.regexp_replace(F.regexp_replace("fetched_at", r"[:+]", "-"), r"\.[0-9]+", "")
    return responses.select(F.concat(stamp, F.lit("-"), F.substring(digest, 1, 16)).alias("name"), F.upper("method").alias("method"), redact(F.col("url")).alias("url"), safe_headers(F.col("headers")).alias("headers"), "status", "fetched_at", digest.alias("sha256"), F.octet_length("body").cast("long").alias("byte_length"), "body")


def archive(responses: DataFrame, path: str) -> None:
    """Adds responses to an archive; of a name that is there already nothing is written again."""
    spark = responses.sparkSession
    rows = archive_rows(responses).dropDuplicates(["name"])
    schema = rows.schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    rows.join(spark.read.schema(schema).parquet(path).select("name"), "name", "left_anti").select(*schema.names).write.mode("append").parquet(path)


def put(responses: DataFrame, path: str) -> None:
    """Adds responses (``method``, ``url``, ``accept``, ``status``, ``fetched_at``, ``source``, ``etag``, ``last_modified``, ``body``) to a store: a body that is there is not written again, nor is a request; raises if a request's key stands for another request."""
    spark = responses.sparkSession
    r = responses.withColumns({"request_key": request_key(F.col("method"), F.col("url"), F.col("accept")), "sha256": F.sha2("body", 256), "url": canonical(F.col("url")), "method": F.upper(F.trim("method"))})
    have = table(spark, path, "requests")
    clash = r.join(have.select("request_key", F.col("method").alias("m"), F.col("url").alias("u")), "request_key").where("method <> m or url <> u")
    if not clash.isEmpty():
        raise IntegrityError("a request's key stands for another request")
    one = r.groupBy("request_key").agg(F.min(F.struct("method", "url", "accept", F.col("fetched_at").alias("created_at"))).alias("q")).select("request_key", "q.*")
    new_requests = one.join(have.select("request_key"), "request_key", "left_anti")
    blobs = r.select("sha256", "body", F.octet_length("body").cast("long").alias("byte_length")).dropDuplicates(["sha256"]).join(table(spark, path, "blobs").select("sha256"), "sha256", "left_anti")
    top = table(spark, path, "responses").agg(F.coalesce(F.max("response_id"), F.lit(0))).first()[0]
    from .export import numbered

    records = numbered(r.select("request_key", "sha256", "status", "fetched_at", "source", "etag", "last_modified"), F.col("fetched_at").asc(), F.col("request_key").asc(), F.col("sha256").asc(), name="n").withColumn("response_id", F.col("n") + top)
    for name, rows in (("requests", new_requests), ("blobs", blobs), ("responses", records)):
        rows.select(*(x.split(" ")[0] for x in SCHEMAS[name].split(", "))).write.mode("append").parquet(f"{path}/{name}")


def get(wanted: DataFrame, path: str) -> DataFrame:
    """The newest response of each wanted request (``method``, ``url``, ``accept``) with its body; ``error`` where there is none or the body is not what the record says."""
    spark = wanted.sparkSession
    w = wanted.select("method", "url", "accept", request_key(F.col("method"), F.col("url"), F.col("accept")).alias("request_key"))
    last = table(spark, path, "responses").groupBy("request_key").agg(F.max_by(F.struct("sha256", "status", "fetched_at", "source", "response_id"), "response_id").alias("r")).select("request_key", "r.*")
    out = w.join(last, "request_key", "left").join(table(spark, path, "blobs"), "sha256", "left")
    broken = (F.sha2("body", 256) != F.col("sha256")) | (F.octet_length("body") != F.col("byte_length"))
    return out.withColumn("error", F.when(F.col("response_id").isNull(), "not cached").when(F.col("body").isNull() | broken, "integrity"))


def missing(wanted: DataFrame, path: str) -> DataFrame:
    """The wanted requests that are still to be made: those without a response in the store."""
    return get(wanted, path).where(F.col("error") == "not cached").select("method", "url", "accept")


def integrity(spark: SparkSession, path: str) -> DataFrame:
    """``kind`` and ``id`` of what is wrong in a store: bodies that are not their digest or length, responses without body or request, repeated keys."""
    b, r, q = (table(spark, path, n) for n in ("blobs", "responses", "requests"))
    rows = b.where((F.sha2("body", 256) != F.col("sha256")) | (F.octet_length("body") != F.col("byte_length"))).select(F.lit("body").alias("kind"), F.col("sha256").alias("id"))
    rows = rows.unionByName(r.join(b, "sha256", "left_anti").select(F.lit("response_without_body").alias("kind"), F.col("response_id").cast("string").alias("id")))
    rows = rows.unionByName(r.join(q, "request_key", "left_anti").select(F.lit("response_without_request").alias("kind"), F.col("response_id").cast("string").alias("id")))
    for df, key, kind in ((b, "sha256", "body_repeated"), (q, "request_key", "request_repeated"), (r, "response_id", "response_repeated")):
        rows = rows.unionByName(df.groupBy(key).count().where("count > 1").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id")))
    return rows


def log_attempts(rows: DataFrame, path: str) -> None:
    rows.select(*(x.split(" ")[0] for x in SCHEMAS["attempts"].split(", "))).write.mode("append").parquet(f"{path}/attempts")


def log_checkpoints(rows: DataFrame, path: str) -> None:
    rows.select(*(x.split(" ")[0] for x in SCHEMAS["checkpoints"].split(", "))).write.mode("append").parquet(f"{path}/checkpoints")


def checkpoints(spark: SparkSession, path: str, attempt_id: str) -> DataFrame:
    return table(spark, path, "checkpoints").where(F.col("attempt_id") == attempt_id).orderBy("position")


def save_evidence(rows: DataFrame, path: str) -> None:
    """Writes evidence (``evidence``, ``body``) under its digest, into a folder that must not be there yet."""
    rows.select(F.sha2("body", 256).alias("name"), "evidence", "body").dropDuplicates(["name"]).write.mode("errorifexists").parquet(path)
