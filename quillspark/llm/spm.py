"""Operator 6, SentencePiece encoding and decoding by vectorised merge rounds.

Texts are cut before each run of spaces and at line ends, where no piece of the model reaches across. Each distinct
word of a batch becomes symbols in flat numpy arrays; a round finds the pair of best score of each word (leftmost of
equals) and merges it in all words at once; finished words leave the arrays. Characters that the model lacks become
byte pieces.

Null text counts as empty and has no ids; rows repeat as they come; an empty table gives an empty table; other
columns are dropped. Very long words take a heap instead of rounds, with the same order of merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Merges, lexicon
from .common import bound_batches, texts

_SPACE = "▁"
_OTHER = 1 << 24


class PieceModel:
    """A BPE model of the sentencepiece library with byte fallback, an an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normaliser, dummy prefix and plain spaces are supported")
        if any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p and len(p) > 1 for p in normal):
            raise ValueError("a piece reaches across words")
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):  # characters that only occur inside pieces
            self.symbol[c] = len(m.pieces) + len(self.symbol)
        order = {s: r for r, s in enumerate(sorted({m.pieces[i].score for i in normal.values()}, reverse=True))}
        self.merges = Merges({
            (self.symbol[p[:k]], self.symbol[p[k:]]): (order[m.pieces[i].score], i)
            for p, i in normal.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol
        })
        self.size = len(m.pieces)
        self.byte = [byte[b] for b in range(256)]
        self.text = [b"" if p.type in (2, 3) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(_SPACE, " ").encode() for p in m.pieces]
        self.outside = {s: c for c, s in self.symbol.items() if s >= self.size}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "of_char"):  # built by each worker; other characters become symbols that no pair has
            self.of_char = np.arange(0x110000) + _OTHER
            chars = [c for c in self.symbol if len(c) == 1]
            self.of_char[[ord(c) for c in chars]] = [self.symbol[c] for c in chars]
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        flat, sizes = self.merges.merge(self.of_char[codes], np.fromiter(map(len, words), np.int64, len(words)))
        odd = np.flatnonzero(flat >= self.size)
        if len(odd):
            made = [[self.byte[b] for b in (chr(x - _OTHER) if x >= _OTHER else self.outside[x]).encode()] for x in flat[odd].tolist()]
            width = np.ones(len(flat), np.int64)
            width[odd] = [len(x) for x in made]
            owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), width)
            from_byte = np.repeat(flat >= self.size, width)
            flat = np.repeat(flat, width)
            flat[from_byte] = [i for x in made for i in x]
            sizes = np.bincount(owner, minlength=len(sizes))
        return flat, sizes

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")

    def words(self, text: str) -> list[str]:
        return _WORDS.findall(_SPACE + text.replace(" ", _SPACE)) if text else []


_WORDS = re.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (string) of every whole text."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(PieceModel(model_path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = lexicon(m, m.encode_words)
        for b in batches:
            cut = [m.words(t) for t in b.column(1).to_pylist()]
            per = np.array([len(x) for x in cut], np.int64)
            flat = [w for x in cut for w in x]
            rows = words.rows(flat)
            ids = words.gather(rows)
            sizes = np.r_[0, np.cumsum(words.size[rows].astype(np.int64))][np.r_[0, np.cumsum(per)]]
            plain = ids.tolist()
            decoded = [m.decode(plain[a:e]) for a, e in zip(sizes[:-1], sizes[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
