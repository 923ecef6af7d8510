"""Operator 10, mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Topics are fitted to the corpus: the ``TOPICS`` most widespread words of five letters or more that at most half of the
documents have. A document's topic is the one of them that it has most often (of equal ones the more widespread), or
``general``. Tokens are counted as the pieces into which word tokenizers first cut a text: runs of letters, single digits
and runs of other signs; the merges of a tokenizer have no native form.

Token counts are summed by cell of source, language and topic. The cells' factors are raked to each margin in turn,
``STEPS`` times: in one row of arrays for up to ``ROW`` cells, by grouped sums, a table a step, beyond that; both give the
same factors. Each document has its cell's factor, is drawn with the probability factor / largest factor, so that the
expected tokens follow the target shares, and is kept if its identifier's hash is below.

Null source, language and text are the values ``''``; a cell without tokens keeps factor 0 only if its margins have none.
Rows of equal doc_id share a draw, as do null doc_ids. An empty table gives an empty table; other columns are carried along
under ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Target shares are the observed ones to this power, normalised, unless given.
TEMPER, STEPS, ROW, TOPICS = 0.9, 12, 2_000, 8
MARGINS = ("source", "lang", "topic")
GENERAL = "general"
#: Pieces of a text and words that can name a topic; white space is these characters, in Spark and in SQL engines alike.
PIECE, TOPIC_WORD = r"\p{L}+|\p{N}|[^ \t\r\n\p{L}\p{N}]+", r"\p{L}{5,}"


def topics(docs: DataFrame) -> list[str]:
    """The words that name topics, the most widespread first, from all documents."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOPIC_WORD), F.lit(0)))).alias("word"))
    most = docs.count() / 2
    found = words.groupBy("word").count().where(F.col("count") <= most).orderBy(F.desc("count"), "word").limit(TOPICS)
    return [r["word"] for r in found.collect()]  # TOPICS rows


def topic(text: Column, names: list[str]) -> Column:
    if not names:
        return F.lit(GENERAL)
    hits = F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\p{L})(?:" + "|".join(names) + r")(?!\p{L})"), F.lit(0))
    counts = lambda h: F.transform(F.array(*map(F.lit, names)), lambda w, i: F.struct(F.size(F.filter(h, lambda x: x == w)).alias("n"), (-i).alias("i"), w.alias("w")))
    named = F.transform(F.array(hits), lambda h: F.when(F.size(h) == 0, GENERAL).otherwise(F.array_max(counts(h))["w"]))  # an array of one binds the hits once
    return F.coalesce(F.element_at(named, 1), F.lit(GENERAL))  # never null, so that the join asks for it once


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE)).cast("long")


def _given(targets: dict[str, float], value: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))[value], F.lit(0.0))


def factors(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``source``, ``lang``, ``topic`` and ``factor`` of each cell (with ``weight``, its tokens). Cells are a written table."""
    return factors_in_row(cells, targets) if cells.count() <= ROW else factors_in_rounds(cells, targets)


def factors_in_rounds(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``factors`` of any number of cells: sums of a margin are grouped, and joined to its cells."""
    now = cells.select(*MARGINS, F.col("weight").cast("double").alias("weight"), F.lit(1.0).alias("factor"))
    total = float(cells.agg(F.sum("weight")).first()[0] or 0.0)
    goals = {}
    for m in MARGINS:
        share = _given(targets[m], F.col(m)) if targets and m in targets else F.pow(F.sum(F.col("weight").cast("double")), F.lit(TEMPER))
        goal = written(cells.groupBy(m).agg(share.alias("share")), f"goal-{m}")
        whole = goal.agg(F.sum("share")).first()[0] or 1.0
        goals[m] = goal.select(m, (F.col("share") / whole * total).alias("goal"))
    for _ in range(STEPS):
        for m in MARGINS:
            sums = now.groupBy(m).agg(F.sum(F.col("weight") * F.col("factor")).alias("sum")).join(goals[m], m)
            scale = sums.select(m, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("scale"))
            now = written(now.join(scale, m).select(*MARGINS, "weight", (F.col("factor") * F.col("scale")).alias("factor")), "raked")
    return now


def factors_in_row(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``factors`` of a few cells, in one row."""
    row = cells.agg(*(F.sort_array(F.collect_set(m)).alias(f"v{k}") for k, m in enumerate(MARGINS)), F.sort_array(F.collect_list(F.struct(*MARGINS, F.col("weight").cast("double").alias("w")))).alias("cells"))
    row = row.withColumn("cells", F.transform("cells", lambda c: F.struct(*(c[m].alias(m) for m in MARGINS), *((F.array_position(F.col(f"v{k}"), c[m]) - 1).cast("int").alias(f"i{k}") for k, m in enumerate(MARGINS)), c["w"].alias("w"))))
    def total_of(cells: Column | str) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["w"])

    def cells_of(k: int) -> Column:
        return F.transform(f"v{k}", lambda _, j: F.filter("cells", lambda c: c[f"i{k}"] == j))

    def target(k: int, m: str) -> Column:
        if targets and m in targets:
            return F.transform(f"v{k}", lambda v: _given(targets[m], v))
        return F.transform(f"g{k}", lambda g: F.pow(total_of(g), F.lit(TEMPER)))

    row = row.withColumn("total", total_of("cells"))
    for k, m in enumerate(MARGINS):  # the cells of each value, and its target
        row = row.withColumn(f"g{k}", cells_of(k)).withColumn("share", target(k, m)).withColumn("shares", F.aggregate("share", F.lit(0.0), lambda a, x: a + x))
        row = row.withColumn(f"t{k}", F.transform("share", lambda t: t / F.col("shares") * F.col("total")))

    def refitted(fs: list[Column], k: int) -> Column:
        a, b = (x for x in range(3) if x != k)

        def fitted(g: Column, j: Column) -> Column:
            now = F.aggregate(g, F.lit(0.0), lambda s, c: s + c["w"] * F.get(fs[a], c[f"i{a}"]) * F.get(fs[b], c[f"i{b}"]))
            return F.when(now > 0, F.get(F.col(f"t{k}"), j) / now).otherwise(0.0)

        return F.transform(f"g{k}", fitted)

    def rake(state: Column, step: Column) -> Column:
        fs = [state[f"f{k}"] for k in range(3)]
        return F.struct(*(F.when(step % 3 == k, refitted(fs, k)).otherwise(fs[k]).alias(f"f{k}") for k in range(3)))

    def one(k: int) -> Column:
        return F.transform(f"v{k}", lambda _: F.lit(1.0)).alias(f"f{k}")

    row = row.withColumn("fit", F.aggregate(F.sequence(F.lit(0), F.lit(3 * STEPS - 1)), F.struct(*map(one, range(3))), rake))
    cell = row.select(F.explode("cells").alias("c"), "fit")
    factor = F.get(F.col("fit.f0"), F.col("c.i0")) * F.get(F.col("fit.f1"), F.col("c.i1")) * F.get(F.col("fit.f2"), F.col("c.i2"))
    return cell.select(*(F.col(f"c.{m}").alias(m) for m in MARGINS), F.col("c.w").alias("weight"), factor.alias("factor"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``row`` (all columns of a document), ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``, ``probability`` and ``kept``."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    names = topics(docs.select("text"))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.source", F.lit("")).alias("source"), F.coalesce("row.lang", F.lit("")).alias("lang"), topic(text, names).alias("topic"), tokens(text).alias("n_tokens"))
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("weight")), "cells")
    found = written(factors(cells, targets), "factors")
    whole = found.agg(F.max("factor").alias("top"), F.count("*").alias("n")).first()
    chance = found.select(*MARGINS, (F.col("factor") / F.lit(whole["top"] or 1.0)).alias("probability"))
    chance = F.broadcast(chance) if whole["n"] <= ROW else chance
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.join(chance, list(MARGINS)).select("row", "doc_id", *MARGINS, "n_tokens", "probability", (draw < F.col("probability")).alias("kept"))
