"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents an Arrow batch holds at most, and its bytes, so that very long texts do not gather in one batch.
BATCH_ROWS, BATCH_BYTES = 512, "32m"


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the columns named; other columns of any name are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later steps neither recompute it nor need the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing is read from them any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has written between its steps; results that were not saved are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
