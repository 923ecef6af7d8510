"""The queries of the ten operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contentsort, cws, langid, mixing, simhash, spans, spm, suffix, tokencount, toxic


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cws.fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs, ~langid.held_out(F.col("doc_id"))))
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    covered = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("passages").alias("n_passage"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: White space of a text, as a class of a regular expression.
_W = " \\t\\n\\x0b\\x0c\\r"
SQL_OP4 = f"""
WITH d AS MATERIALIZED (SELECT *, row_number() OVER () AS d FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
e AS (SELECT d, regexp_extract_all(regexp_replace(text, '^[{_W}]+', ''), '[^{_W}]+[{_W}]*') AS ws FROM d),
w0 AS (SELECT d, unnest(ws) AS piece, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM e),
w1 AS (SELECT *, lower(regexp_replace(piece, '[{_W}]+$', '')) AS word FROM w0),
w2 AS (SELECT *, (regexp_matches(word, '[.!?]$') OR regexp_matches(piece, '[\\r\\n]') OR i = n)::INT AS stop FROM w1),
w3 AS (SELECT *, sum(stop) OVER (PARTITION BY d ORDER BY i) - stop AS s FROM w2),
w4 AS (SELECT *, count(*) OVER (PARTITION BY d, s) AS size, count(*) OVER f AS width, min(substr(md5(word), 1, 8) || lpad(i::VARCHAR, 12, '0')) OVER f AS least
  FROM w3 WINDOW f AS (PARTITION BY d, s ORDER BY i ROWS BETWEEN CURRENT ROW AND {spans.WINDOW - 1} FOLLOWING)),
cuts AS (SELECT DISTINCT d, substr(least, 9)::BIGINT AS i FROM w4 WHERE size > {spans.WORDS} AND width = {spans.WINDOW}),
w5 AS (SELECT w4.*, (stop = 1 OR cuts.i IS NOT NULL)::INT AS cut FROM w4 LEFT JOIN cuts ON cuts.d = w4.d AND cuts.i = w4.i),
w6 AS (SELECT *, sum(cut) OVER (PARTITION BY d ORDER BY i)::BIGINT - cut AS u FROM w5),
u AS MATERIALIZED (SELECT d, u, string_agg(word, ' ' ORDER BY i) AS norm, string_agg(piece, '' ORDER BY i) AS piece FROM w6 GROUP BY d, u),
a AS (SELECT d, list(norm ORDER BY u) AS v, list(piece ORDER BY u) AS pieces FROM u GROUP BY d),
p AS (SELECT a.d, u AS pos, list_slice(v, u + 1, u + {spans.LEAST}) AS v, len(v) AS n FROM a JOIN u ON u.d = a.d AND (u + {spans.RUN} <= len(v) OR u = 0)),
q AS (SELECT d, pos, v, list_filter(range(least({spans.RUN}, n), len(v) + 1), lambda k: length(array_to_string(list_slice(v, 1, k), ' ')) >= {spans.LEAST})[1] AS k FROM p),
r AS (SELECT q.d, pos, k, array_to_string(list_slice(v, 1, k), ' ') AS run, d.doc_id FROM q JOIN d ON d.d = q.d WHERE k IS NOT NULL),
x AS (SELECT d, pos, k, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, d, pos) AS place FROM r),
g AS (SELECT d, list_distinct(flatten(list(range(pos, pos + k)))) AS gone FROM x WHERE place > 1 GROUP BY d),
f AS (SELECT d.doc_id, d.text, coalesce(len(a.v), 0) AS n_sentences, coalesce(len(g.gone), 0) AS n_removed,
  CASE WHEN g.gone IS NULL THEN d.text ELSE CASE WHEN list_contains(g.gone, 0) THEN '' ELSE regexp_extract(d.text, '^[{_W}]*') END
  || array_to_string(list_transform(list_filter(range(0, len(a.v)), lambda i: NOT list_contains(g.gone, i)), lambda i: a.pieces[i + 1]), '') END AS kept
  FROM d LEFT JOIN a ON a.d = d.d LEFT JOIN g ON g.d = d.d)
SELECT documents.doc_id, n_sentences, n_removed, sha256(kept) AS kept_sha256
FROM documents JOIN f ON f.doc_id IS NOT DISTINCT FROM documents.doc_id AND f.text = coalesce(documents.text, '')"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spm.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.exact_duplicates(table(spark, sf_dir, "documents"))


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_OP7 = f"""
WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencount.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxic.score(docs, toxic.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= toxic.THRESHOLD).alias("toxic"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def _sql_op10() -> str:
    parts = [
        "t AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)",
        f"h AS MATERIALIZED (SELECT d, unnest(regexp_extract_all(lower(text), '{mixing.TOPIC_WORD}')) AS word FROM t)",
        "wc AS MATERIALIZED (SELECT d, word, count(*) AS n FROM h GROUP BY d, word)",
        f"names AS MATERIALIZED (SELECT word, count(*) AS docs FROM wc GROUP BY word HAVING count(*) <= (SELECT count(*) FROM t) / 2 ORDER BY docs DESC, word LIMIT {mixing.TOPICS})",
        "best AS (SELECT d, word FROM wc JOIN names USING (word) QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, docs DESC, word) = 1)",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, len(regexp_extract_all(text, '{mixing.PIECE}')) AS n_tokens, coalesce(best.word, '{mixing.GENERAL}') AS topic FROM t LEFT JOIN best USING (d))",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w, sum(n_tokens)::DOUBLE AS x FROM d GROUP BY ALL)",
    ]
    for m in mixing.MARGINS:
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(w), {mixing.TEMPER}) / sum(pow(sum(w), {mixing.TEMPER})) OVER () * (SELECT sum(w) FROM c0) AS target FROM c0 GROUP BY {m})")
    k = 0
    for _ in range(mixing.STEPS):
        for m in mixing.MARGINS:
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, w, CASE WHEN s > 0 THEN x * target / s ELSE 0 END AS x FROM (SELECT *, sum(x) OVER (PARTITION BY {m}) AS s FROM c{k}) JOIN t_{m} USING ({m}))")
            k += 1
    parts.append(f"f AS MATERIALIZED (SELECT source, lang, topic, (x / w) / max(x / w) OVER () AS p FROM c{k} WHERE w > 0)")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0) < p AS kept
FROM d JOIN f USING (source, lang, topic)"""


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_fingerprints, op2_langid, op3_suffix_dedup, op4_sentence_spans, op5_simhash, op6_sentencepiece, op7_exact_dedup, op8_token_counts, op9_toxicity, op10_mixing)
    return {f.__name__: f for f in ops} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op4_sentence_spans": SQL_OP4, "op7_exact_dedup": SQL_OP7, "op10_mixing": _sql_op10()}
