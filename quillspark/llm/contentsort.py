"""Operator 7, exact deduplication by a content sort, in DataFrame operations.

Rows are range-partitioned by sampled splitters of the first ``PREFIX`` characters of the normalised text and a salt
of the identifier, then sorted by the whole normalised text, externally where it does not fit in memory; equal texts
of a salt are then neighbours, and comparing neighbours in full ends each group. A text's groups, at most one for
each of ``SALTS`` salts, then meet by their digest, without their texts.

Null text counts as empty and equals an empty text. A null doc_id is less than any other and stays only where no other
row has the text. Of rows that repeat both doc_id and text one stays. An empty table gives an empty table; other columns
are dropped, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, texts, written

PREFIX, SALTS = 48, 64


def normalised(text: Column) -> Column:
    """Only A-Z become lower case. Texts in ASCII alone take the quick way, with the same result."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``keep_id`` (the largest doc_id with the text), ``group_size``, ``kept`` and ``text_sha256`` of every row."""
    rows = texts(docs).withColumn("prefix", normalised(F.substring("text", 1, PREFIX))).withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(SALTS)).cast("int"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "prefix", "salt").withColumn("norm", normalised(F.col("text")))
    same = Window.partitionBy("prefix", "salt", "norm").orderBy(F.col("doc_id").desc_nulls_last())
    rows = rows.select("doc_id", "salt", "prefix", "norm", F.row_number().over(same).alias("place"), F.last(F.lit(1)).over(same).alias("one"))
    rows = written(rows.select("doc_id", "salt", "place", F.sha2("norm", 256).alias("text_sha256")), "contentsort")
    parts = rows.groupBy("text_sha256", "salt").agg(F.max("place").cast("long").alias("size"), F.max("doc_id").alias("top"))
    whole = parts.groupBy("text_sha256").agg(F.sum("size").alias("group_size"), F.max("top").alias("keep_id"), F.max_by("salt", F.struct("top", "salt")).alias("keep_salt"))
    known = parts.select("text_sha256", "salt").join(whole, "text_sha256")
    return rows.join(known, ["text_sha256", "salt"]).select("doc_id", "keep_id", "group_size", ((F.col("place") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept"), "text_sha256")
