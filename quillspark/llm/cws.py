"""Operator 1, document fingerprints by consistent weighted sampling.

The terms of a text are its runs of ``SHINGLE`` lower-case words, weighted by how often each occurs (a shorter text is
one term). Each of ``SAMPLES`` samples draws for a term r and c from Gamma(2, 1) and b uniformly, all functions of the
hash of that term and sample alone; with t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r, the term of least a and
its t are the sample. Two texts agree in a sample with the probability of their generalised Jaccard similarity.

The draws come from three independent exponentials A, G and E: c = A + G and A / c, a uniform, are independent, so with
x = ln(c / A), also exponential, r = x + E and b = E / r have the distributions above. At weight 1 a is A itself, whose
order is that of the hash it is drawn from, so only repeated terms and each sample's least hash need logarithms.

Null text counts as empty; texts without words are alike (1) among themselves and unlike (0) all others. Rows with equal
doc_id follow each other by their text; null doc_ids come last. Equal rows all stay; a table of one row is its own
next; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions, texts

SAMPLES, SHINGLE = 128, 5
_ROWS = 512
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def lowered(text: str) -> str:
    """Lower case of each character by itself, so that a part of a text has its part of the words."""
    return text.replace("Σ", "σ").lower()


class _Words(dict):
    """Hashes of words; those met are kept."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _exponential(h: np.ndarray) -> np.ndarray:
    """Exponential draws in the order of the hashes that make them."""
    return -np.log1p(-(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53))


def _again(h: np.ndarray, salt: int) -> np.ndarray:
    """Further independent hashes of a hash."""
    x = (h ^ np.uint64(salt)) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(32))


class Sampler:
    def __init__(self, samples: int = SAMPLES, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(0, 1 << 63, (samples, 1), np.uint64)
        self.factor = rng.integers(1, 1 << 63, (samples, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = rng.integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
        self.word = _Words()

    def hashes(self, terms: np.ndarray) -> np.ndarray:
        """A hash of each sample (row) and term (column)."""
        x = self.salt ^ terms
        x *= self.factor
        x ^= x >> np.uint64(32)
        x *= _MIX
        return x

    def draws(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and b by these hashes."""
        a, g, e = _exponential(h), _exponential(_again(h, 0x9E3779B97F4A7C15)), _exponential(_again(h, 0xC2B2AE3D27D4EB4F))
        c = a + g
        r = np.log(c / a) + e
        return r, np.log(c), e / r

    def words(self, text: str) -> np.ndarray:
        words = lowered(text).split()
        return np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))

    def edited_words(self, text: str, following: str, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Hashes of the words of ``edited(text, following)``, from those of both texts: only words at the cuts are new."""
        half = len(text) // 2
        a, b = lowered(text[: len(text) - half]), lowered(following[:half])
        joined = a and b and not a[-1].isspace() and not b[0].isspace()
        a, b = a.split(), b.split()
        middle = [*a[-1:], *b[:1]] if not joined else [a[-1] + b[0]]
        cut = [self.word[w] for w in middle]
        last = [self.word[b[-1]]] if len(b) > 1 else []
        return np.concatenate([own[: max(0, len(a) - 1)], np.array(cut, np.uint64), other[1 : max(1, len(b) - 1)], np.array(last, np.uint64)])

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct terms, in order, and their weights, from the hashes of the words."""
        if len(self.word) > 500_000:
            self.word.clear()
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k = min(SHINGLE, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            x = h[i : len(h) - k + 1 + i] * self.power[i]
            out = out * np.uint64(0x9E3779B97F4A7C15) + (x ^ (x >> np.uint64(29)))
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return np.unique(out, return_counts=True)

    def signature(self, words: np.ndarray) -> np.ndarray:
        terms, weight = self.terms(words)
        n = len(self.factor)
        if not len(terms):
            return np.zeros(n, np.uint16)
        once = terms[weight == 1]
        least, who = np.full(n, np.iinfo(np.uint64).max, np.uint64), np.zeros(n, np.uint64)
        each = np.arange(n)
        for s in range(0, len(once), _ROWS):
            h = self.hashes(once[s : s + _ROWS])
            at = h.argmin(axis=1)  # of equals the smallest term
            value = h[each, at]
            better = value < least
            least[better], who[better] = value[better], once[s + at[better]]
        best, level = np.log(_exponential(least)) if len(once) else np.full(n, np.inf), np.zeros(n, np.int64)
        many = np.flatnonzero(weight > 1)
        for s in range(0, len(many), _ROWS):
            h, w = terms[many[s : s + _ROWS]], weight[many[s : s + _ROWS]]
            r, lnc, b = self.draws(self.hashes(h))
            t = np.floor(np.log(w)[None, :] / r + b)
            lna = lnc - r * (t - b) - r
            at = lna.argmin(axis=1)
            value = lna[each, at]
            better = value < best
            best[better], who[better], level[better] = value[better], h[at[better]], t[each, at][better].astype(np.int64)
        x = (who ^ level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * _MIX
        return (x >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text, the last half of it replaced by as much of the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each text and its edited form, their fingerprints (hexadecimal) and likenesses.

    Rows are dealt into ranges of doc_id by splitters that occur in the table; the row of a splitter leads its range and
    is also sent to the range before, as the one that follows its last row."""
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions(spark)
    rows = texts(docs)
    ranges_n = 8 * n  # so many that partitions get about as many each
    cuts = sorted({x for x in (rows.select(F.percentile_approx("doc_id", [k / ranges_n for k in range(1, ranges_n + 1)], 10_000)).first()[0] or []) if x is not None}, reverse=True)
    top = rows.agg(F.max("doc_id")).first()[0]
    cuts = cuts if not cuts or cuts[0] == top else [top, *cuts]
    split = F.array(*map(F.lit, cuts)).cast("array<long>")
    own = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(split, lambda x: x >= F.col("doc_id"))))
    last = F.lit(len(cuts))
    lead = F.array_contains(split, F.col("doc_id"))
    if cuts:
        ranges = F.when(lead, F.array(own, F.when(own == 1, last).otherwise(own - 1))).otherwise(F.array(own))
    else:
        ranges = F.array(own)
    dealt = rows.select("doc_id", "text", F.posexplode(ranges).alias("tail", "part")).repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        hexed = lambda s: s.astype(">u2").tobytes().hex()
        prior = first = None  # (doc_id, text, signature, part, words); first: of the part
        out: list[tuple] = []

        def pair(a: tuple, b: tuple) -> None:
            e = edited(a[1], b[1])
            s = a[2] if e == a[1] else sampler.signature(sampler.edited_words(a[1], b[1], a[4], b[4]))
            out.append((a[0], a[1], e, hexed(a[2]), hexed(s), likeness(a[2], s), likeness(a[2], b[2])))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), *[pa.string()] * 4, pa.float64(), pa.float64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        done = False  # of this part: a tail has followed its last row
        for b in batches:
            for doc_id, text, tail, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if prior and prior[3] != part:
                    if not done:
                        pair(prior, first)
                    prior, done = None, False
                if tail and (done or not prior):
                    continue
                words = sampler.words(text)
                now = (doc_id, text, sampler.signature(words), part, words)
                if prior:
                    pair(prior, now)
                    done = bool(tail)
                if not tail:
                    first = first if prior else now
                    prior = now
            yield flush()
        if prior and not done:
            pair(prior, first)
        yield flush()

    return dealt.mapInArrow(run, _OUT)
