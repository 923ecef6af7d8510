"""Operator 4, substring deduplication by sliding sentence spans.

A text is cut into sentences after words that end in ``.``, ``!`` or ``?`` and at line ends. A sentence of more than ``WORDS``
words is cut further where its words say so: after the word of least digest of every ``WINDOW`` words (the first of equal
ones), so that equal passages have equal cuts whatever precedes them. Every run of ``RUN`` consecutive sentences (all
sentences of a shorter text), as lower-case words, is hashed to 128 bits; one of fewer than ``LEAST`` characters is
lengthened by the sentences that follow. Runs are joined globally; the first occurrence of a run is the one of least doc_id
(null: last), text hash and place; sentences that any later occurrence covers are removed.

Null text counts as empty. A text without words has no sentences and stays as it is; white space before the first word
belongs to the first sentence. Rows that repeat both doc_id and text count as one document and get equal results. An empty
table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, texts, written

RUN, WORDS, LEAST, WINDOW = 3, 16, 50, 12
GROUP = 2 << 20
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Numbers of the words met, and of each, in lower case, its digest (cut key and two hashes) and length."""

    def __init__(self) -> None:
        self.digests: list[bytes] = []
        self.sizes: list[int] = []
        self.table = np.zeros((0, 4), np.uint64)

    def __missing__(self, word: bytes) -> int:
        if word.isascii():
            low, size = word.lower(), len(word)
        else:
            text = word.decode("utf-8", "surrogatepass").lower()
            low, size = text.encode("utf-8", "surrogatepass"), len(text)
        self[word] = n = len(self.sizes)
        self.digests.append(hashlib.md5(low).digest())
        self.sizes.append(size)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """The four numbers of each word."""
        if len(self) > 500_000:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if known := self.digests:
            raw = np.frombuffer(b"".join(known), ">u8").reshape(-1, 2).astype(np.uint64)
            self.table = np.concatenate([self.table, np.column_stack([raw[:, 0] >> np.uint64(32), raw, np.array(self.sizes[len(self.table) :], np.uint64)])])
            known.clear()
        return self.table[at]


def groups(texts_: list[str]) -> Iterator[list[bytes]]:
    """Texts in order, as bytes, in groups of about ``GROUP`` bytes at most (a longer text by itself), which bounds the arrays below."""
    held: list[bytes] = []
    size = 0
    for text in texts_:
        raw = text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > GROUP:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def units(raws: list[bytes], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sentences, cut, of texts laid end to end: how many each text has, where each begins among the words (with an end), where in its text's bytes, and the words' numbers."""
    whole = b"\n".join(raws) + b"\n"
    data = np.frombuffer(whole, np.uint8)
    white = np.r_[True, _WHITE[data]]
    first = np.flatnonzero(white[:-1] & ~white[1:])
    text_end = np.cumsum([len(r) + 1 for r in raws])
    if not len(first):
        return np.zeros(len(raws), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
    stop = np.flatnonzero(~white[:-1] & white[1:])  # of each word, exclusive
    of_word = words.of(whole.split())
    n = len(first)
    lines = np.flatnonzero((data == 10) | (data == 13))
    ends = np.isin(data[stop - 1], np.frombuffer(b".!?", np.uint8))
    ends[:-1] |= np.searchsorted(lines, stop[:-1]) < np.searchsorted(lines, first[1:])
    ends[-1] = True
    sentence = np.cumsum(ends) - ends
    if n >= WINDOW:
        m = (of_word[:, 0] << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: n - WINDOW + 1], m[WINDOW - width :][: n - WINDOW + 1])
        inside = (sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :]) & (np.bincount(sentence)[sentence[: n - WINDOW + 1]] > WORDS)
        ends[(m[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    begin = np.r_[0, np.flatnonzero(ends) + 1]
    text = np.searchsorted(text_end, first[begin[:-1]], "right")
    size = np.bincount(text, minlength=len(raws))
    place = first[begin[:-1]] - np.r_[0, text_end[:-1]][text]
    place[(np.cumsum(size) - size)[size > 0]] = 0  # the first of a text takes the white space before it
    return size, begin, place, of_word


def runs(size: np.ndarray, begin: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, number of sentences and two hashes of each run."""
    n = len(begin) - 1
    chars = np.r_[0, np.cumsum(of_word[:, 3].astype(np.int64) + 1)][begin]  # up to each sentence, a space after every word
    text = np.repeat(np.arange(len(size)), size)
    low, high = (np.cumsum(size) - size)[text], np.cumsum(size)[text]
    at = np.arange(n)
    at = at[(at + RUN <= high) | (at == low)]
    end = np.maximum(np.searchsorted(chars, chars[at] + LEAST + 1), np.minimum(at + RUN, high[at]))
    at, end = at[end <= high[at]], end[end <= high[at]]
    hashes = []
    for column, step in ((1, _ONE), (2, _TWO)):  # polynomials over the words, from the start of the run
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(of_word), step)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(of_word), np.uint64(pow(int(step), -1, 1 << 64)))])
        upto = np.r_[np.uint64(0), np.cumsum(of_word[:, column] * power[:-1])]
        h = (upto[begin[end]] - upto[begin[at]]) * back[begin[at]]
        h ^= (begin[end] - begin[at]).astype(np.uint64) * _TWO
        hashes.append((h ^ (h >> np.uint64(29))) * _ONE)
    return text[at], at - low[at], end - at, hashes[0], hashes[1]


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for b in batches:
        done = 0
        for raws in groups(b.column("text").to_pylist()):
            size, begin, _, of_word = units(raws, words)
            text, pos, n, h1, h2 = runs(size, begin, of_word)
            own = pa.array(text + done)
            done += len(raws)
            long = lambda h: pa.array(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("t").take(own), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int8)), long(h1), long(h2)], ["doc_id", "t", "pos", "n_run", "h1", "h2"])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for b in batches:
        ids, gone, done = b.column("doc_id"), b.column("gone").to_pylist(), 0
        for raws in groups(b.column("text").to_pylist()):
            size, _, place, _ = units(raws, words)
            start = np.cumsum(size) - size
            n_removed, kept = [], []
            for raw, s, n, found in zip(raws, start.tolist(), size.tolist(), gone[done : done + len(raws)], strict=True):
                if not found:
                    n_removed.append(0)
                    kept.append(raw.decode("utf-8", "surrogatepass"))
                    continue
                edge = np.zeros(n + 1, np.int64)
                for g in found:
                    edge[g["pos"]] += 1
                    edge[g["pos"] + g["n_run"]] -= 1
                off = np.cumsum(edge[:-1]) > 0
                cut = [*place[s : s + n].tolist(), len(raw)]
                n_removed.append(int(off.sum()))
                kept.append(b"".join(raw[cut[i] : cut[i + 1]] for i in np.flatnonzero(~off).tolist()).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([ids.slice(done, len(raws)), pa.array(size.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_sentences", "n_removed", "kept"])
            done += len(raws)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_sentences``, ``n_removed``, ``kept`` (the text of the other sentences) of every whole text."""
    bound_batches(docs.sparkSession)
    rows = texts(docs).withColumn("t", F.xxhash64("text"))
    each = written(rows.mapInArrow(_run_rows, "doc_id long, t long, pos int, n_run byte, h1 long, h2 long"), "spans")
    again = written(each.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "repeated-spans")  # tables, so that Spark can split the join of a frequent run
    found = written(each.join(again, ["h1", "h2"]), "spans-of-repeated")
    discard(each, again)  # the largest table by far: later steps, and later runs of the application, need its room
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "pos")
    first = written(found.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first-spans")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t")) & (F.col("pos") == F.col("first.pos"))
    gone = found.join(first, ["h1", "h2"]).where(~same).groupBy("doc_id", "t").agg(F.collect_set(F.struct("pos", "n_run")).alias("gone"))
    gone = written(gone.select(F.col("doc_id").alias("g"), F.col("t").alias("gt"), "gone"), "removed-spans")
    discard(found, first)
    of_row = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("t") == F.col("gt")), "left").select("doc_id", "text", "gone")
    return of_row.mapInArrow(_kept_rows, "doc_id long, n_sentences long, n_removed long, kept string")
