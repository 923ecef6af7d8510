"""Archived responses as a data source, and loaders of the other files a run reads."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.validate import InvalidInput

_SCHEMA = "run string, page int, cursor string, status int, body string"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Pages of one file of JSON lines, in order. A line that is no page becomes a page without a body, which ends its run as partial."""
        with open(partition.value, encoding="utf-8") as f:
            for n, line in enumerate(f):
                try:
                    p = json.loads(line)
                    body = p.get("body")
                    yield str(p["run"]), int(p.get("page", n)), p.get("cursor"), int(p.get("status", 200)), body if isinstance(body, str) or body is None else json.dumps(body)
                except (ValueError, KeyError, TypeError, AttributeError):
                    yield partition.value, n, None, None, None


class ArchivedPages(DataSource):
    """``spark.read.format("archived_pages").option("paths", "a.jsonl,b.jsonl")``: a file a task, since a cursor's pages follow each other. Files must be on a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "archived_pages"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options.get("paths", "").split(",") if p]
        if not paths:
            raise InvalidInput("option paths is required")
        return _Reader(paths)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchivedPages)


def raw_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Archived bodies joined to their metadata by file name: ``name``, ``method``, ``url``, ``status``, ``fetched_at``, ``body`` and ``error`` where the body is missing or is not what the metadata say."""
    meta = "request struct<method:string,url:string>, fetched_at string, http_status int, response struct<body_file:string,byte_length:long,sha256:string>"
    m = spark.read.schema(meta).option("pathGlobFilter", "*.metadata.json").json(folder, multiLine=True)
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.response").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("body_file"), F.col("content").alias("body"))
    r = m.select("request.*", "fetched_at", F.col("http_status").alias("status"), "response.*").join(b, "body_file", "left")
    error = F.when(F.col("body").isNull(), "missing").when(~F.sha2("body", 256).eqNullSafe(F.col("sha256")) | (F.octet_length("body") != F.col("byte_length")), "integrity")
    return r.select(F.col("body_file").alias("name"), "method", "url", "status", "fetched_at", "body", error.alias("error"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole log files: ``log``, ``line`` (from 1), ``value`` and ``ended``. A log is read whole, since its lines are numbered; logs are read in parallel."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), F.col("value").alias("whole"))
    ended = F.col("whole").endswith("\n")
    parts = F.split(F.regexp_replace("whole", r"\n\z", ""), "\n")
    rows = raw.where(F.length("whole") > 0).select("log", ended.alias("ended"), F.size(parts).alias("n"), F.posexplode(parts).alias("i", "value"))
    return rows.select("log", (F.col("i") + 1).alias("line"), "value", ((F.col("i") + 1 < F.col("n")) | F.col("ended")).alias("ended"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``body`` and ``error`` of files that must each hold one JSON object."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    v = F.try_parse_json("body")
    return raw.withColumn("error", F.when(v.isNull(), "unreadable").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object"))


def media_type(c: Column) -> Column:
    """A content type without its parameters."""
    return F.lower(F.trim(F.split_part(c, F.lit(";"), F.lit(1))))
