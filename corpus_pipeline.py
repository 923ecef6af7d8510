"""A training corpus from ``documents`` in five stages, each over all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import contentsort, langid, mixing, simhash, spm
from quillspark.llm.common import written

#: Posterior below which language identification rejects a document, as it does one without letters.
LEAST_SCORE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """Rows as ``row``, so that no name clashes, with their doc_id as ``id`` and a null text as empty in ``text``."""
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    return rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.coalesce("row.text", F.lit("")).alias("text"))


def _one_of_each(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows whose ``id`` and ``key`` are in ``kept`` (``kept_id``, ``kept_key``); of rows that repeat both one, of the least text."""
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col(key) == F.col("kept_key")), "left_semi")
    return found.withColumn("k", F.row_number().over(Window.partitionBy("id", key).orderBy("text"))).where("k = 1").select("row.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language: those with a letter, a posterior of ``LEAST_SCORE`` and, from ``langid.MEASURED`` bytes on, no more bits a byte than ``langid.limits``.

    Null and empty texts have no letter and go. Rows repeat as they come; null doc_ids are never trained on; without a labelled
    row all go; an empty table stays empty."""
    trained = ~langid.held_out(F.col("doc_id"))
    trees = langid.train(docs, trained)
    found = langid.predict(docs, trees).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    if not trees.langs:
        return found.select("row.*")
    limit = F.create_map(*(F.lit(x) for kv in langid.limits(docs, trees, trained).items() for x in kv))
    foreign = (F.octet_length("row.text") >= langid.MEASURED) & (F.col("bits_per_byte") > limit[F.col("lang_pred")])
    return found.where(~foreign).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, as ``contentsort`` keeps it: the largest doc_id, a null one only where no other has the text.

    Null text counts as empty, and one such document stays. Of rows that repeat both doc_id and text one stays. An empty table stays empty."""
    kept = contentsort.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_key"))
    return _one_of_each(_rows(docs).withColumn("sha", F.sha2(contentsort.normalised(F.col("text")), 256)), kept, "sha")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of least doc_id (null: last), then of least text hash.

    Null, empty and wordless texts are one group. Rows that repeat a doc_id are told apart by their texts; of those that repeat both one
    stays. An empty table stays empty."""
    kept = simhash.representatives(docs).select(F.col("doc_id").alias("kept_id"), F.col("t").alias("kept_key"))
    return _one_of_each(_rows(docs).withColumn("t", F.xxhash64("text")), kept, "t")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come to their target shares.

    Null source, language and text count as empty ones. Rows of one doc_id share a draw, as do null doc_ids. An empty table stays empty."""
    return mixing.mix(docs).where("kept").select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, as digests.

    Null text counts as empty and has none. Rows repeat as they come; an empty table stays empty."""
    found = spm.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the language model nor SimHash nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
