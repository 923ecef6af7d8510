"""The ten operators: brute force or a library on small tables, and rows that are null, empty, long or repeated."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import bpe, common, contentsort, cws, langid, mixing, simhash, spans, spm, suffix, tokencount, toxic
from quillspark.llm.components import components

LONG = "ab cd. " * 4000
PASSAGE = "".join(chr(97 + (i * i * 7 + i // 5) % 26) if i % 6 else " " for i in range(900))
ROWS = [
    (1, "The cat sat on the mat. It was warm. The dog slept under the old table.", "en", "s1"),
    (2, "THE cat sat on the mat. It was warm. The dog slept under the old table.", "en", "s1"),
    (2, "THE cat sat on the mat. It was warm. The dog slept under the old table.", "en", "s1"),
    (3, None, None, None), (4, "", "en", "s2"), (None, "x", "de", "s1"), (5, "   \n\t ", "en", "s1"),
    (6, LONG, "fr", "s1"), (7, "left " + PASSAGE + " right", "en", "s2"), (8, PASSAGE + " else", "de", "s3"), (9, "12345 !!! é 日本 \x00", "fr", "s3"), (None, None, None, "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("clash") for c in ("fp", "t1", "row", "norm", "salt", "u", "kept", "weight", "probability", "text_sha256", "part", "topic")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_cws(docs, empty):
    got = cws.fingerprints(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = Counter((r[0], cws.edited(r[1] or "", order[(i + 1) % len(order)][1] or "")) for i, r in enumerate(order))
    assert Counter((r.doc_id, r.edited) for r in got) == want
    assert len({r.fingerprint for r in got if r.text == ROWS[1][1]}) == 1
    assert cws.fingerprints(empty).count() == 0


def _weights(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_cws_estimates_weighted_jaccard():
    s = cws.Sampler(4096)
    a, b = "a b c d e f g h a b c d e f g h i j k l", "a b c d e f g h i j k l m n o p"
    ta, tb = _weights(a), _weights(b)
    true = sum((ta & tb).values()) / sum((ta | tb).values())
    assert abs(cws.likeness(s.signature(s.words(a)), s.signature(s.words(b))) - true) < 0.03


@pytest.mark.parametrize("n", [300, 20_000])
def test_cws_of_long_texts(n):
    """Texts of 20,000 words: the mean error within three standard errors, spread as of independent samples."""
    s, rng, errors = cws.Sampler(), np.random.default_rng(n), []
    for k in range(40):
        blocks = [[f"{k}-{i}-{j}" for j in range(50)] for i in range(n // 50)]
        write = lambda bs: " ".join(w for b in bs for w in b * int(rng.integers(1, 4)))  # noqa: B023, E731
        a, b = write(blocks), write(blocks[: n // 60] + [[w + "x" for w in x] for x in blocks[n // 60 :]])
        ta, tb = _weights(a), _weights(b)
        true = sum((ta & tb).values()) / sum((ta | tb).values())
        errors.append((cws.likeness(s.signature(s.words(a)), s.signature(s.words(b))) - true) / (true * (1 - true) / cws.SAMPLES) ** 0.5)
    assert abs(np.mean(errors)) < 3 / 40**0.5
    assert 0.65 < np.std(errors) < 1.45


def test_cws_equals_plain_draws():
    """Every sample by the formula of its draws, one term after another."""
    s = cws.Sampler()
    text = "a b c d e f g h " * 3 + " ".join(map(str, range(40)))
    terms, weights = s.terms(s.words(text))
    r, lnc, b = s.draws(s.hashes(terms))
    want = []
    for k in range(cws.SAMPLES):
        best = min((lnc[k, i] - r[k, i] * (np.floor(np.log(w) / r[k, i] + b[k, i]) - b[k, i]) - r[k, i], int(h), int(np.floor(np.log(w) / r[k, i] + b[k, i]))) for i, (h, w) in enumerate(zip(terms, weights, strict=True)))
        x = ((best[1] ^ best[2] * 0x9E3779B97F4A7C15 % (1 << 64)) * int(cws._MIX)) % (1 << 64)
        want.append(x >> 48 | 1)
    assert s.signature(s.words(text)).tolist() == want


def test_cws_draws_have_their_distributions():
    h = cws.Sampler(1).hashes(np.random.default_rng(2).integers(0, 1 << 63, 200_000, np.uint64))
    r, lnc, b = cws.Sampler(1).draws(h)
    for x, mean, var in ((r, 2, 2), (np.exp(lnc), 2, 2), (b, 0.5, 1 / 12)):
        assert abs(x.mean() - mean) < 0.02
        assert abs(x.var() - var) < 0.05
    for x, y in ((r, lnc), (r, b), (lnc, b)):
        assert abs(np.corrcoef(x.ravel(), y.ravel())[0, 1]) < 0.01


def test_langid(spark, docs, empty):
    en, de = "the house and the garden with this thing", "das haus und der garten mit diesem ding"
    train = spark.createDataFrame([(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    trees = langid.train(train, ~langid.held_out(F.col("doc_id")))
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.predict(train, trees).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(200))
    odd = [r.lang_pred for r in langid.predict(docs, trees).where("row.doc_id in (3, 4, 5)").collect()]
    assert odd == ["und"] * 3
    assert {r.lang_pred for r in langid.predict(train, langid.train(empty, F.lit(True))).collect()} == {"und"}
    assert langid.predict(empty, trees).count() == 0
    assert [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0] == [r.i for r in spark.range(50).toDF("i").where(langid.held_out(F.col("i"))).collect()]


def test_code_lengths_sum_to_one(spark):
    data = np.frombuffer(b"\n\n\nabracadabra abracadabra", np.uint8).astype(np.int64)
    gram = sum(data[i : len(data) - 3 + i] << (8 * (3 - i)) for i in range(4))
    g, n = np.unique(gram, return_counts=True)
    t = langid.ContextTrees(["x"], [(0, g, n)])
    def bits(raw):
        return float(t.lengths(raw, np.array([len(raw)]))[0, 0]) if raw else 0.0

    for context in (b"", b"a", b"ab", b"bra", b"zzz"):
        assert abs(sum(2 ** (bits(context) - bits(context + bytes([c]))) for c in range(256)) - 1) < 1e-3


def _covered(raw, n):
    """Of each text the bytes that a string of n bytes covers which also starts elsewhere."""
    seen = Counter(t[i : i + n] for _, t in raw for i in range(len(t) - n + 1))
    for _, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            gone[i : i + n] |= seen[t[i : i + n]] > 1
        yield gone


def _check_suffix(rows, found):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    want = Counter()
    for (d, t), gone, short in zip(raw, _covered(raw, suffix.LENGTH), _covered(raw, suffix.PASSAGE), strict=True):
        spans_ = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[d, len(t), int(gone.sum()), spans_, bytes(b for b, g in zip(t, gone, strict=True) if not g), int(short.sum())] += 1
    got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept), sum(s.end - s.start for s in r.passages)) for r in found.collect())
    assert got == want


def test_suffix(docs, empty):
    _check_suffix(ROWS, suffix.remove_repeats(docs))
    assert suffix.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("split", [2, 1500])
def test_suffix_across_shards(spark, monkeypatch, split):
    """Passages of lengths around the limits between unlike texts; with a split of two, their contexts meet only by merging."""
    monkeypatch.setattr(suffix, "SPLIT", split)
    rng = np.random.default_rng(4)
    prose = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passages = [prose(n) for n in (200, 255, 256, 300, 399, 400, 401, 450, 900)]
    rows = [(i, prose(int(rng.integers(0, 300))) + "".join(rng.choice(passages, rng.integers(0, 4))) + prose(int(rng.integers(0, 300)))) for i in range(40)]
    _check_suffix(rows, suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 500):
        codes = rng.integers(0, 3, n).astype(np.uint16)
        plain = codes.tolist()
        sa, known, shared = suffix.suffix_array(codes)
        assert sa.tolist() == sorted(range(n), key=lambda i: plain[i:])
        lcp = suffix.common_prefixes(codes.astype(np.uint8), np.arange(n, 0, -1), sa, known, 0, 40, lanes=7)
        for k in range(1, n):
            a, b = plain[sa[k - 1] :], plain[sa[k] :]
            assert lcp[k] == min(40, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def test_window_classes():
    """Windows of contexts that share long parts, by both lengths, against their bytes."""
    rng = np.random.default_rng(6)
    part = bytes(rng.integers(97, 100, 700).astype(np.uint8))
    contexts = [part[a:b] + bytes(rng.integers(97, 100, 40).astype(np.uint8)) for a, b in rng.integers(0, 350, (12, 2)) + [0, 350]] + [b"ab" * 300, b"ab" * 301]
    counts = [max(1, min(len(c) - suffix.PASSAGE + 1, 150)) for c in contexts]
    owner, start, short, long = suffix.window_classes(contexts, counts)
    windows = [contexts[o][s:] for o, s in zip(owner, start, strict=True)]
    for cls, n in ((short, suffix.PASSAGE), (long, suffix.LENGTH)):
        whole = [i for i, w in enumerate(windows) if len(w) >= n]
        pairs = {(windows[i][:n], int(cls[i])) for i in whole}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((c == -1) == (len(w) < suffix.LENGTH) for c, w in zip(long, windows, strict=True))


def test_spans(docs, empty):
    got = {r.doc_id: r for r in spans.remove_repeats(docs).collect() if r.doc_id is not None}
    assert got[1].n_removed == 0
    assert got[2].n_removed == got[2].n_sentences == 3
    assert got[2].kept == ""
    assert (got[3].n_sentences, got[3].kept) == (0, "")
    assert spans.remove_repeats(docs).count() == len(ROWS)
    assert spans.remove_repeats(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1
    assert by[3].fp == 0
    assert by[3].component_id == by[4].component_id == 3
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_are_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False))) for b in base for _ in range(12)]
    fps = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    label = simhash.bk_groups(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = root(int(i)), root(int(j))
        parent[max(a, b)] = min(a, b)
    want = {frozenset(k for k in range(len(fps)) if root(k) == r) for r in map(root, range(len(fps)))}
    assert {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())} == want
    signed = fps.view(np.int64).tolist()
    old, simhash.HOT = simhash.HOT, 3
    try:
        found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    finally:
        simhash.HOT = old
    groups: dict = {}
    for r in found:
        groups.setdefault(r.root, set()).add(signed.index(r.node))
    assert {frozenset(g) for g in groups.values()} == {g for g in want if len(g) > 1}


def test_pieces(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in spm.encode(docs, path).collect())
    assert got == Counter((r[0], tuple(lib.encode(r[1] or "")), lib.decode(lib.encode(r[1] or ""))) for r in ROWS)
    assert spm.encode(empty, path).count() == 0


def test_long_words_merge_alike():
    m = spm.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁" + "lorem" * 30, "▁" * 40 + "the", "abracadabra" * 9]
    flat, sizes = m.encode_words(words)
    m.merges.LONG = 1
    again, same = m.encode_words(words)
    assert (flat.tolist(), sizes.tolist()) == (again.tolist(), same.tolist())
    assert bpe.Merges({}).merge(np.array([1, 2]), np.array([2]))[0].tolist() == [1, 2]


def test_exact(docs, empty):
    got = contentsort.exact_duplicates(docs).collect()
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    keep, size = {}, Counter()
    for r in ROWS:
        size[norm(r[1])] += 1
        keep[norm(r[1])] = max(-1 if r[0] is None else r[0], keep.get(norm(r[1]), -1))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((r[0], None if keep[norm(r[1])] < 0 else keep[norm(r[1])], size[norm(r[1])], sha(norm(r[1]))) for r in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(size)
    assert contentsort.exact_duplicates(empty).count() == 0


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_tokens) for r in tokencount.count(docs, path).collect())
    assert got == Counter((r[0], len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert tokencount.count(empty, path).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_transducer_equals_pattern(chunk, monkeypatch):
    import regex

    monkeypatch.setattr(tokencount, "_CHUNK", chunk)
    for t in ("don't we'll 'rx 'lx ''s x''re ,'s it's'", "'", "'l", "ab12 é'v 'd'd", ""):
        t += "\n"
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        want = [m.start() for m in regex.finditer(tokencount.PATTERN, t)]
        assert np.flatnonzero(tokencount.begins(codes)).tolist() == want


def test_toxic(spark, docs, empty):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 3))
    rows = [(i, " ".join(word() for _ in range(40)) + (" vile" if i % 5 == 0 else ""), 0 if i % 7 == 0 else 1, 1 if i % 5 == 0 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    chain = toxic.train(df.drop("quality", "toxic"), df.select("doc_id", "quality", "toxic"))
    got = {r.doc_id: r.p_toxic >= toxic.THRESHOLD for r in toxic.score(df, chain).collect()}
    assert sum(got[i] == (i % 5 == 0) for i in range(400)) >= 396
    assert toxic.score(docs, chain).count() == len(ROWS)
    none = toxic.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxic.score(docs, none).count() == len(ROWS)


def _plain_fit(x, dense, y):
    """The linear model of one category over a plain matrix of features, by the same steps."""
    if y.min() == y.max():
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        return np.zeros(x.shape[1]), np.r_[np.zeros(dense.shape[1]), np.log(p / (1 - p))]
    yes, no = x.T @ y + 0.5, x.T @ (1 - y) + 0.5
    ratio = np.log(yes / (y.sum() + 1)) - np.log(no / (len(y) - y.sum() + 1))
    ratio = np.where(np.abs(ratio) < toxic.LEAST_RATIO, 0, ratio)
    z = np.c_[x * ratio, dense, np.ones(len(y))]
    w = np.r_[np.full(x.shape[1], 0.1), np.zeros(dense.shape[1] + 1)]
    decay = np.r_[np.full(x.shape[1], 1e-4), np.zeros(dense.shape[1] + 1)]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, toxic.STEPS + 1):
        g = z.T @ ((toxic._sigmoid(z @ w) - y) * weight / len(y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return ratio * w[: x.shape[1]], w[x.shape[1] :]


def test_chain_equals_plain_chain_with_out_of_fold_inputs():
    """The later model learns from predictions of models that have not seen the row; rows without a label for a category still feed the next."""
    rng = np.random.default_rng(5)
    docs_ = [" ".join(rng.choice(["good", "vile", "plain", "word", "more", "text", "here"], 12)) for _ in range(80)]
    labels = np.column_stack([[float("good" in d.split()[:4]) for d in docs_], [float("vile" in d.split()[:4]) for d in docs_]])
    labels[::9, 1] = np.nan
    folds = np.arange(80) % toxic.FOLDS
    sets = [set(toxic.features(d)) for d in docs_]
    chain = toxic.Chain(["a", "b"], sets, labels, folds)
    matrix = np.array([[float(f in s) for f in chain.column] for s in sets])
    size = np.log1p(matrix.sum(axis=1))[:, None]
    dense, shown = size, size
    for c in range(2):
        known = ~np.isnan(labels[:, c])
        out = np.zeros(80)
        for k in range(toxic.FOLDS):
            train, rest = known & (folds != k), folds == k
            w, u = _plain_fit(matrix[train], dense[train], labels[train, c])
            out[rest] = toxic._sigmoid(matrix[rest] @ w + np.c_[dense[rest], np.ones(rest.sum())] @ u)
        w, u = _plain_fit(matrix[known], dense[known], labels[known, c])
        dense = np.c_[dense, out]
        shown = np.c_[shown, toxic._sigmoid(matrix @ w + np.c_[shown, np.ones(80)] @ u)]
    assert np.abs(chain.predict(docs_) - shown[:, 1:]).max() < 1e-6
    in_fold = np.abs(dense[:, 1] - shown[:, 1])
    assert in_fold.max() > 1e-3  # the inputs it learned from are not the fitted ones


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.probability <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[3].topic == by[4].topic == mixing.GENERAL
    assert (by[3].n_tokens, by[9].n_tokens) == (0, 9)
    assert by[6].n_tokens == 12_000
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("fit", [mixing.factors_in_row, mixing.factors_in_rounds])
def test_raking(spark, fit):
    cells = spark.createDataFrame([("a", "x", "p", 10.0), ("a", "y", "q", 30.0), ("b", "x", "q", 40.0), ("b", "y", "p", 20.0)], "source string, lang string, topic string, weight double")
    share = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"p": 0.45, "q": 0.55}}
    out = fit(cells, share).collect()
    for m, wanted in share.items():
        for v, s in wanted.items():
            assert abs(sum(r.weight * r.factor for r in out if r[m] == v) / 100 - s) < 0.02


def test_raking_alike_in_row_and_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(0, 50))) for i in range(4) for j in range(3) for k in range(3) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, weight double")
    one, many = ({tuple(r[m] for m in mixing.MARGINS): r.factor for r in f(cells).collect()} for f in (mixing.factors_in_row, mixing.factors_in_rounds))
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)


def test_topics_are_widespread_words(spark):
    texts_ = ["apple apple grape the", "APPLE melon", "grape melon melon lemon", "lemon", "melon", None, "xxxxx1apple"]
    d = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    names = mixing.topics(d.select("text"))
    assert names[:2] == ["apple", "melon"]
    got = {r.doc_id: r.t for r in d.select("doc_id", mixing.topic(F.coalesce("text", F.lit("")), names).alias("t")).collect()}
    assert [got[i] for i in range(7)] == ["apple", "apple", "melon", "lemon", "melon", mixing.GENERAL, "apple"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_bits():
    t = "one two three four FIVE six"
    w = t.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(3)]
    assert simhash.simhash(t) == sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 3)


def test_spans_shifted_and_short(spark):
    def words(k, n):
        return " ".join(hashlib.md5(f"{k} {i}".encode()).hexdigest()[:6] for i in range(n))

    passage, short = words("p", 60), "Oh no. Go. Ah. Yes. It is. Run. Who? Me. So. Up. Do. See. Not now. Why? Ha. Hm."
    rows = [(1, f"{words('a', 5)} {passage} {words('b', 9)}"), (2, f"{words('c', 8)} {passage} {words('d', 3)}"), (3, f"Start one. {short}"), (4, f"{words('e', 4)}. {short} {words('f', 4)}.")]
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == got[3].n_removed == 0
    left = got[2].kept.split()
    assert set(words("c", 8).split() + words("d", 3).split()) <= set(left)
    assert len(set(passage.split()) & set(left)) < 30
    assert got[4].kept.split() == f"{words('e', 4)}. {words('f', 4)}.".split()


def test_sentences_keep_text():
    texts = ["a b. c\n\nd e !  f .", "x " * 13, " . .. a.b c? ! d\t\r\ne", "", " \n", " ".join(f"w{i % 5}" for i in range(5000)), "one. " + "two three " * 10 + "end. last"]
    raws = [t.encode() for t in texts]
    size, begin, place, _ = spans.units(raws, spans._Words())
    at = 0
    for raw, n in zip(raws, size.tolist(), strict=True):
        cut = [*place[at : at + n].tolist(), len(raw)]
        sentences = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        assert b"".join(sentences) == (raw if n else b"")
        assert [len(x.split()) for x in sentences] == np.diff(begin[at : at + n + 1]).tolist()
        at += n


def _sentences(text):
    """Sentences of a text by a plain reading of the rules."""
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text)
    out, held = [], []
    for w in words:
        held.append(w)
        if re.search(r"[.!?]$", w.strip()) or re.search(r"[\r\n]", w):
            out.append(held)
            held = []
    out += [held] * bool(held)
    parts = []
    for s in out:
        low = [hashlib.md5(w.strip().lower().encode()).hexdigest()[:8] for w in s]
        after = {min(range(i, i + spans.WINDOW), key=lambda k: low[k]) + 1 for i in range(len(s) - spans.WINDOW + 1)} if len(s) > spans.WORDS else set()
        ends = sorted(after | {len(s)})
        parts += [" ".join(w.strip().lower() for w in s[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    return parts


def test_spans_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    bank = [" ".join(f"w{rng.integers(40)}" for _ in range(rng.integers(1, 50))) + rng.choice([". ", "\n", " ", "! "]) for _ in range(25)]
    docs = [(i, "".join(rng.choice(bank, rng.integers(0, 12)))) for i in range(60)] + [(60, None), (61, "Ä ß. " * 9)]
    first, cover = {}, {i: set() for i, _ in docs}
    of = {i: _sentences(t or "") for i, t in docs}
    for i, u in of.items():
        for p in range(max(len(u) - spans.RUN, 0) + 1 if u else 0):
            n = next((n for n in range(min(spans.RUN, len(u)), len(u) - p + 1) if len(" ".join(u[p : p + n])) >= spans.LEAST), None)
            if n and first.setdefault(" ".join(u[p : p + n]), (i, p)) != (i, p):
                cover[i] |= set(range(p, p + n))
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: (r.n_sentences, r.n_removed) for i, r in got.items()} == {i: (len(of[i]), len(cover[i])) for i in of}
    assert all(0 < len(cover[i]) < len(of[i]) for i in (5, 6))  # a part of a text goes
    for i, r in got.items():
        assert _joined(r.kept) == _joined(" ".join(s for k, s in enumerate(of[i]) if k not in cover[i]))


def _joined(text):
    return " ".join(text.lower().split())


def test_intermediate_tables_are_cleared(spark, tmp_path, monkeypatch):
    from quillspark.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    common.written(spark.range(3).toDF("x"), "t")
    assert list(tmp_path.rglob("*.parquet"))
    common.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_spans_leave_only_the_table_that_the_result_reads(spark):
    """The tables of runs and repeats are gone when the result is there, so that repeated runs do not pile them up."""
    from pathlib import Path

    where = Path(common.shared_dir(spark)) / "quillspark" / spark.sparkContext.applicationId
    text = "One two three four five six seven. Eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen. "
    before = set(where.glob("*"))
    found = spans.remove_repeats(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string"))
    assert [x.name.rsplit("-", 1)[0][:13] for x in set(where.glob("*")) - before] == ["removed-spans"]
    assert sorted((r.doc_id, r.n_removed) for r in found.collect()) == [(1, 0), (2, 3), (3, 0)]
