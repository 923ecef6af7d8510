"""Each stage against a brute-force version of what it decides, on its own input, and on rows that are null, empty, long or repeated."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillspark.llm import langid, mixing, simhash

from ..conftest import SF

LONG = "word and word. " * 20_000
ROWS = [
    (1, "The first text of them all, with many plain words in it.", "en", "a"), (1, "Another text under the same identifier, quite unlike it.", "en", "a"),
    (2, "THE FIRST text of them all, with many plain words in it.", "en", "b"), (2, "THE FIRST text of them all, with many plain words in it.", "en", "b"),
    (3, None, None, None), (4, "", "en", "b"), (None, "A text without an identifier.", "en", None), (None, None, None, None), (5, LONG, "en", "a"), (6, "12 34", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


class Naive:
    """Prediction by partial matching by its definition: counts of what follows each context, escapes by method C, seen bytes excluded."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(langid.ORDER + 1)]
        for t in texts:
            raw = b"\n" * langid.ORDER + t.encode()
            for i in range(langid.ORDER, len(raw)):
                for k in range(langid.ORDER + 1):
                    self.counts[k][raw[i - k : i], raw[i]] += 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = out.collect()
        ids = {r.doc_id for r in kept}
        if name == "language_id":
            trees = langid.train(docs, ~langid.held_out(F.col("doc_id")))
            limit = langid.limits(docs, trees, ~langid.held_out(F.col("doc_id")))
            want = set()
            for r in rows:
                raw = r.text.encode()
                if re.search(r"[^\W\d_]", r.text):
                    bits = trees.lengths(raw, np.array([len(raw)]))[0] if raw else []
                    best = min(range(len(bits)), key=lambda k: bits[k])
                    score = 1 / sum(2 ** -min(b - bits[best], 500) for b in bits)
                    if score >= corpus_pipeline.LEAST_SCORE and (len(raw) < langid.MEASURED or bits[best] / len(raw) <= limit[trees.langs[best]]):
                        want.add(r.doc_id)
            assert ids == want
            assert ids >= {r.doc_id for r in rows if len(re.findall(r"[^\W\d_]", r.text)) > 40}
        elif name == "exact_dedup":
            last = {}
            for r in rows:
                last[r.text.lower()] = max(r.doc_id, last.get(r.text.lower(), -1))
            assert ids == set(last.values())
        elif name == "simhash_near_dedup":
            fps = {r.doc_id: simhash.simhash(r.text) for r in rows}
            group = {d: d for d in fps}
            for _ in fps:
                new = {a: min(group[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 4) for a in fps}
                if new == group:
                    break
                group = new
            assert ids == {d for d, g in group.items() if d == g}
        else:
            chance = {r.doc_id: r.probability for r in mixing.mix(docs).collect()}
            draw = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) / 2**32 for d in chance}
            assert ids == {d for d, p in chance.items() if draw[d] < p}
        docs, rows = spark.createDataFrame(kept, docs.schema), kept
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(r.doc_id, len(model.encode(r.text)), sha(",".join(map(str, model.encode(r.text)))), sha(model.decode(model.encode(r.text)))) for r in rows}
    assert {tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == want
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "row", "k", "t", "sha", "kept_id", "fp", "topic")})


def test_stages_on_odd_rows(spark, odd):
    def kept(name):
        out = dict(corpus_pipeline.STAGES)[name](spark, odd, SF)
        assert out.columns == odd.columns
        return Counter((r.doc_id, r.text) for r in out.collect())

    rows = [r[:2] for r in ROWS]
    language = kept("language_id")
    assert language == Counter(r for r in rows if r[1] and re.search("[a-z]", r[1]))
    assert kept("exact_dedup") == Counter([rows[1], rows[2], rows[5], rows[6], rows[8], rows[9]])
    assert kept("simhash_near_dedup") == Counter([rows[0], rows[1], rows[4], rows[6], rows[8], rows[9]])
    assert not kept("mix_sources") - Counter(rows)
    out = dict(corpus_pipeline.STAGES)["sentencepiece"](spark, odd, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert {r.n_tokens for r in out if r.doc_id in (3, 4)} == {0}


def test_stages_on_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_a_foreign_text_goes(spark):
    known = [(i, f"the quick brown fox number {i} jumps over the lazy dog and runs along the river bank " * 4, "en", "s") for i in range(60)]
    foreign = [(100, "zxqj vwkp ñandú çok güzel şey łódź żółć ěščř " * 8, None, "s"), (101, "これは日本語の文章です。" * 20, None, "s")]
    out = corpus_pipeline.identify_language(spark, spark.createDataFrame(known + foreign, SCHEMA), SF)
    assert {r.doc_id for r in out.collect()} == set(range(60))


def test_code_lengths_equal_naive_matching(spark):
    """Every byte's cost by the definition: share or escape in each context, longest first, seen bytes excluded. Contexts seen once are left out."""
    texts = {"a": ["abracadabra, abra cadabra", "a bad cab"], "b": ["banana bandana", "band and banana band"]}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    trees = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    naive = {k: Naive(ts) for k, ts in texts.items()}
    seen = {b for ts in texts.values() for t in ts for b in t.encode()} | {10}
    every = [Counter() for _ in range(langid.ORDER + 1)]
    for m in naive.values():
        for k, c in enumerate(m.counts):
            for (context, _), n in c.items():
                every[k][context] += n
    known = lambda c: not c or (every[len(c)][c] >= langid.LEAST and known(c[1:]))

    def cost(model, context, byte):
        share = dict.fromkeys(range(256), 1 / 256)
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            if k and not known(c):
                break
            count = {b: model.counts[k][c, b] for b in range(256) if model.counts[k][c, b]}
            total, kinds = sum(count.values()), len(count)
            if total:
                rest = 1 - sum(share[b] for b in count)
                share = {b: count[b] / (total + kinds) if b in count else share[b] * kinds / (total + kinds) / max(rest, 1e-9) for b in share}
        return -math.log2(max(share[byte], 1e-12))

    for text in ("abra band", "cab nana", "dad"):
        raw = text.encode()
        got = trees.lengths(raw, np.array([len(raw)]))[0]
        for lang, bits in zip(trees.langs, got, strict=True):
            want = sum(cost(naive[lang], raw[max(0, i - langid.ORDER) : i], raw[i]) for i in range(len(raw)))
            assert bits == pytest.approx(want, rel=1e-4)
    assert seen >= set(b"abrcd")


def test_language_model_and_limits_are_of_all_rows(spark):
    """4,000 rows of one language: counts are those of every text, and the dearest text of all sets the limit."""
    rng = np.random.default_rng(2)
    texts = [f"plain words number {i} " * 10 for i in range(4000)]
    texts[1234] = bytes(rng.integers(97, 123, 300).astype(np.uint8)).decode()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trees = langid.train(docs, F.lit(True))
    raw = [t.encode() for t in texts]
    grams = Counter((b"\n" * langid.ORDER + r)[i : i + langid.ORDER + 1] for r in raw for i in range(len(r)))
    order = sorted(grams)
    whole = langid.ContextTrees(["x"], [(0, np.array([int.from_bytes(g, "big") for g in order]), np.array([grams[g] for g in order]))])
    assert np.array_equal(trees.bits, whole.bits)
    assert trees.lengths(raw[1234], np.array([300])).tolist() == whole.lengths(raw[1234], np.array([300])).tolist()
    most = (trees.lengths(b"".join(raw), np.cumsum([len(r) for r in raw]))[:, 0] / [len(r) for r in raw]).max()
    assert langid.limits(docs, trees, F.lit(True))["x"] == pytest.approx(most + langid.ROOM)
    assert most == pytest.approx(trees.lengths(raw[1234], np.array([300]))[0, 0] / 300)
