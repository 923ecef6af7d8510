"""Reference lists: entries that run over several lines, and the best candidates of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what opens a numbered entry.
MARKER = r"^\s*\[(\d{1,4})\]\s+"


def entries(lines: DataFrame) -> DataFrame:
    """``doc``, ``number``, ``page`` (of its first line), ``n_lines`` and ``entry`` of lines ``doc``, ``page``, ``line``, ``text``.

    A line with a marker opens an entry; lines without one continue it, on later pages too. Lines before the first marker
    belong to none; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    rows = lines.select("doc", "page", "line", text.alias("text"), F.regexp_extract(text, MARKER, 1).alias("number"))
    opened = F.sum((F.col("number") != "").cast("int")).over(Window.partitionBy("doc").orderBy("page", "line"))
    rows = rows.withColumn("place", opened).where("place > 0")
    parts = F.array_sort(F.collect_list(F.struct("page", "line", F.regexp_replace("text", MARKER, "").alias("part"))))
    found = rows.groupBy("doc", "place").agg(F.max(F.when(F.col("number") != "", F.col("number").cast("int"))).alias("number"), parts.alias("parts"))
    return found.select("doc", "number", F.col("parts")[0]["page"].alias("page"), F.size("parts").cast("long").alias("n_lines"), F.array_join("parts.part", " ").alias("entry"))


def best(scored: DataFrame, key: str, score: str, seq: str, n: int) -> DataFrame:
    """The ``n`` rows of best ``score`` of each ``key``, with their ``place``; of equal scores the smaller ``seq`` comes first, null scores come last."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), F.col(seq)))).where(F.col("place") <= n)
