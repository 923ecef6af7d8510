"""Operator 2, language identification by prediction by partial matching.

For each language a byte context tree of variable order up to ``ORDER`` counts what follows each context in all
labelled texts that are trained on. A byte that a context has seen costs its share; any other costs the escape of that context
(method C) and then its share in the next shorter one, with seen bytes excluded; the last resort is uniform over
bytes. The statistics are frozen after training, so the code length of each byte in each context and language is one
table entry, and a text's exact code length in every language is a sum of table rows.

A text that is null or has no letter is ``und`` with score 0; where no row is labelled, all are. Ties go to the language
first in order. Rows repeat as they come; an empty table gives an empty table; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Longest context; contexts seen less often are left out.
ORDER, LEAST = 3, 2
#: Bytes of texts measured or counted at once, about; tree nodes whose code lengths are worked out at once.
GROUP, NODES = 512 << 10, 2048
UND = "und"
#: A text of at least MEASURED bytes that costs ROOM bits a byte more than the dearest training text of its language is foreign to it.
MEASURED, ROOM = 200, 2.0
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class ContextTrees:
    """Frozen context trees of some languages over a common set of contexts.

    ``symbol`` maps bytes to symbols (0: never trained on); ``child[k][node, symbol]`` leads from the context of k bytes
    to the longest known context with that byte before it; ``bits[node, symbol]`` has the code lengths by language."""

    def __init__(self, langs: list[str], grams: list[tuple[int, np.ndarray, np.ndarray]]):
        """grams: (language, grams of ORDER + 1 bytes as big-endian integers, counts)."""
        self.langs = langs
        n_lang = len(langs)
        seen = np.unique(np.concatenate([g >> (8 * k) & 255 for _, g, _ in grams for k in range(ORDER + 1)] or [np.zeros(0, np.int64)]))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        size = len(seen) + 1
        node = [[np.zeros(len(g), np.int64)] for _, g, _ in grams]  # by language, the node of each gram at each level
        known, parent, self.child, self.offset = 1, [np.zeros(1, np.int64)], [], [0]
        for order in range(ORDER):  # contexts one byte longer, where often enough seen
            before = [self.symbol[g >> (8 * (order + 1)) & 255] for _, g, _ in grams]
            keys = [np.where(at[-1] >= 0, at[-1] * size + b, -1) for at, b in zip(node, before, strict=True)]
            every, inverse = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_inverse=True)
            often = np.bincount(inverse, np.concatenate([c for _, _, c in grams] or [np.zeros(0)]), len(every)) >= LEAST
            chosen = every[(every >= 0) & often]
            found = np.full(known * size, -1, np.int64)
            found[chosen] = np.arange(len(chosen))
            for at, k in zip(node, keys, strict=True):
                at.append(np.where(k >= 0, found[np.maximum(k, 0)], -1))
            self.child.append(found.reshape(known, size))
            parent.append(chosen // size)
            self.offset.append(self.offset[-1] + known)
            known = len(chosen)
        self.bits = np.empty(((self.offset[-1] + known), size, n_lang), np.float32)
        top = np.full((1, size, n_lang), 1 / 256)
        top[0, 0] = (256 - len(seen)) / 256 or 1e-9
        for order in range(ORDER + 1):
            events = []
            for (lang, g, c), at in zip(grams, node, strict=True):
                by = np.argsort(at[order], kind="stable")
                events.append((lang, at[order][by], self.symbol[g & 255][by], c[by]))
            here = np.empty((len(parent[order]) if order < ORDER else 0, size, n_lang))  # shares, for the next level
            for low in range(0, len(parent[order]), NODES):
                high = min(low + NODES, len(parent[order]))
                counts = np.zeros((high - low, size, n_lang))
                for lang, at, sym, c in events:
                    i, j = np.searchsorted(at, (low, high))
                    np.add.at(counts, (at[i:j] - low, sym[i:j], lang), c[i:j])
                share = top[parent[order][low:high]]
                total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
                rest = 1 - np.where(counts > 0, share, 0).sum(axis=1, keepdims=True)
                escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1) / np.maximum(rest, 1e-9)
                share = np.where(counts > 0, counts / np.maximum(total + kinds, 1), share * np.where(total > 0, escape, 1))
                bits = self.bits[self.offset[order] + low : self.offset[order] + high]
                bits[:] = -np.log2(np.maximum(share, 1e-12))
                bits[:, 0] += np.float32(np.log2(max(1, 256 - len(seen))))  # symbol 0 stands for so many bytes
                if order < ORDER:
                    here[low:high] = share
            top = here
        self.bits = self.bits.reshape(len(self.bits) * size, n_lang)
        self.size = size
        # child tables as global rows: an unknown longer context stays at the shorter one
        step = []
        for k, table in enumerate(self.child):
            own = self.offset[k] + np.arange(len(table))[:, None]
            step.append(np.where(table >= 0, self.offset[k + 1] + table, own).astype(np.int32))
        self.child = step

    def lengths(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Code lengths in bits of texts laid end to end, by text and language; contexts never cross texts."""
        sym = self.symbol[np.frombuffer(data, np.uint8)]
        row = np.zeros(len(sym), np.int32)
        begin = np.r_[0, ends[:-1]]
        deep = np.arange(len(sym)) - np.repeat(begin, np.diff(np.r_[0, ends]))
        live = np.arange(len(sym))
        for k, table in enumerate(self.child):
            live = live[deep[live] > k]
            after = table[row[live] - self.offset[k], sym[live - k - 1]]
            row[live] = after
            live = live[after >= self.offset[k + 1]]
        cost = np.zeros((len(sym) + 1, len(self.langs)))
        np.cumsum(self.bits[row.astype(np.int64) * self.size + sym], axis=0, dtype=np.float64, out=cost[1:])
        return cost[ends] - cost[begin]


def _labelled(docs: DataFrame, train_on: Column, lang: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(lang).alias("lang"), train_on.alias("t")).where("t and lang is not null and text is not null")


def _groups(raw: list[bytes]) -> Iterator[slice]:
    """Texts in order in groups of about ``GROUP`` bytes at most (a longer text by itself), which bounds the arrays made of them."""
    low, held = 0, 0
    for i, r in enumerate(raw):
        if held and held + len(r) > GROUP:
            yield slice(low, i)
            low, held = i, 0
        held += len(r)
    if low < len(raw):
        yield slice(low, len(raw))


def _grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams that end in a byte of a text, each text after ``ORDER`` line ends, and how often each is there."""
    data = np.frombuffer((b"\n" * ORDER).join([b"", *raw]), np.uint8).astype(np.int64)
    own = np.repeat(np.tile([False, True], len(raw)), np.array([[ORDER, len(r)] for r in raw], np.int64).ravel())[ORDER:]
    gram = sum(data[i : len(data) - ORDER + i] << (8 * (ORDER - i)) for i in range(ORDER + 1))
    return np.unique(gram[own], return_counts=True)


def train(docs: DataFrame, train_on: Column, lang: str = "lang") -> ContextTrees:
    """Trees from all rows that ``train_on`` admits and whose language and text are not null."""
    bound_batches(docs.sparkSession)
    rows = _labelled(docs, train_on, lang)
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # a row a language
    if not langs:
        return ContextTrees([], [])
    number = F.create_map(*(x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which = b.column(0).to_numpy()
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            for k in np.unique(which):
                of_lang = [r for r, w in zip(raw, which, strict=True) if w == k]
                for part in _groups(of_lang):
                    found, n = _grams(of_lang[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(found), pa.array(n)], ["lang", "gram", "n"])

    grams = rows.select(number[F.col("lang")].alias("lang"), "text").mapInArrow(count, "lang int, gram long, n long")
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # grams that differ: they grow much slower than the texts
    who, gram, n = (table.column(i).to_numpy() for i in range(3))
    order = np.lexsort((gram, who))
    who, gram, n = who[order], gram[order], n[order]
    return ContextTrees(langs, [(i, gram[who == i], n[who == i]) for i in range(len(langs))])


def limits(docs: DataFrame, trees: ContextTrees, train_on: Column, lang: str = "lang") -> dict[str, float]:
    """Of each language the bits a byte beyond which a text is foreign to it, from all texts it was trained on."""
    found = predict(_labelled(docs, train_on, lang), trees).where((F.col("lang_pred") == F.col("row.lang")) & (F.octet_length("row.text") >= MEASURED))
    most = {r["lang_pred"]: r["most"] for r in found.groupBy("lang_pred").agg(F.max("bits_per_byte").alias("most")).collect()}  # a row a language
    return {k: most.get(k, 8.0) + ROOM for k in trees.langs}


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """``row`` (all columns of a document), ``lang_pred``, ``score`` (the posterior of that language, all being equally likely before) and ``bits_per_byte``."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(trees)  # a row of code lengths for each context that is known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            raw = [t or "" for t in b.column(0).field("text").to_pylist()]
            data = [t.encode("utf-8", "surrogatepass") for t in raw]
            ok = np.array([bool(m.langs and _LETTER.search(t)) for t in raw])
            best, score, rate = np.zeros(len(raw), int), np.zeros(len(raw)), np.zeros(len(raw))
            size = np.array([len(d) for d in data])
            if ok.any():
                bits = np.concatenate([m.lengths(b"".join(data[g]), np.cumsum(size[g])) for g in _groups(data)])
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                score = 1 / np.exp2(-np.minimum(bits - least[:, None], 500)).sum(axis=1)
                rate = least / np.maximum(size, 1)
            lang = [m.langs[k] if o else UND for k, o in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, rate, 0.0))], ["row", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")
