"""Operator 8, token counts by finite-state tokenizer compilation.

A deterministic transducer over character classes finds where a pre-token begins; contractions are settled with a
delay of one character. Texts of a batch are laid end to end and cut into chunks; each chunk is run from every state
at once, which gives its map from states to states; the maps compose by a parallel prefix scan, which gives each
chunk's true start; a second run then annotates the characters. The word transducer has one transition for each
distinct pre-token, annotated with the tokens it emits, compiled from the merge list when the word is first met.

Null text counts as empty and has no token; rows repeat as they come; an empty table gives an empty table; other
columns are dropped. Strings of special tokens inside a text count as one token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Merges, lexicon
from .common import bound_batches, texts

#: Fixed by the tokenizer file: the pre-token pattern that the transducer below implements.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Character classes: space, number, other, apostrophe, letter, and the letters of contractions.
SPACE, NUMBER, OTHER, QUOTE, LETTER, ENDS, RV, EL, EE = range(9)
#: States: nothing open; a run of letters; a run of others; a quote; a quote and r or v; a quote and l.
START, LETTERS, OTHERS, QUOTED, QUOTED_RV, QUOTED_L = range(6)
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


@cache
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            out[i] = LETTER if kind == "L" else NUMBER
    out[[ord(c) for c in _WHITE]] = SPACE
    for chars, k in (("'", QUOTE), ("stmd", ENDS), ("rv", RV), ("l", EL), ("e", EE)):
        out[[ord(c) for c in chars]] = k
    return out


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks by class and state; a mark's bit 1: a pre-token begins here; bit 2: one began a character ago."""
    step, mark = np.zeros((9, 6), np.uint8), np.zeros((9, 6), np.uint8)
    fresh = {SPACE: (START, 0), NUMBER: (START, 1), OTHER: (OTHERS, 1), QUOTE: (QUOTED, 1)}
    for c in range(9):
        letter = c >= LETTER
        step[c, START], mark[c, START] = (LETTERS, 1) if letter else fresh[c]
        step[c, LETTERS], mark[c, LETTERS] = (LETTERS, 0) if letter else fresh[c]
        step[c, OTHERS], mark[c, OTHERS] = (OTHERS, 0) if c in (OTHER, QUOTE) else (LETTERS, 1) if letter else fresh[c]
        step[c, QUOTED], mark[c, QUOTED] = {ENDS: (START, 0), RV: (QUOTED_RV, 0), EL: (QUOTED_L, 0)}.get(c, (step[c, OTHERS], mark[c, OTHERS]))
        for state, last in ((QUOTED_RV, EE), (QUOTED_L, EL)):
            step[c, state], mark[c, state] = (START, 0) if c == last else (step[c, LETTERS], mark[c, LETTERS] | 2)
    return step, mark


_STEP, _MARK = _transducer()
_N, _CHUNK = 6, 128


def begins(codes: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token. The last character must be white space."""
    cls = classes()[codes]
    n = len(cls)
    grid = np.zeros(-(-n // _CHUNK) * _CHUNK, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(-1, _CHUNK).T).astype(np.intp) * _N
    step, mark = _STEP.ravel().astype(np.intp), _MARK.ravel()
    maps = np.broadcast_to(np.arange(_N), (grid.shape[1], _N)).copy()
    for col in grid:  # each chunk from every state
        maps = step[col[:, None] + maps]
    width = 1
    while width < len(maps):  # inclusive scan: maps[i] becomes the map of all chunks up to i
        later = np.take_along_axis(maps[width:], maps[:-width], axis=1)
        maps = np.concatenate([maps[:width], later])
        width *= 2
    state = np.r_[START, maps[:-1, START]]
    marks = np.empty(grid.shape, np.uint8)
    for j, col in enumerate(grid):
        at = col + state
        marks[j], state = mark[at], step[at]
    marks = marks.T.ravel()[:n]
    out = (marks & 1).astype(bool)
    out[:-1] |= (marks[1:] & 2).astype(bool)
    return out


class WordModel:
    """A tokenizers file of kind BPE with word ends, as the counts of its pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        m = j["model"]
        if m["type"] != "BPE" or m["continuing_subword_prefix"] or PATTERN not in json.dumps(j["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") or [x["type"] for x in j["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("another kind of tokenizer than this transducer is compiled for")
        vocab, end = m["vocab"], m["end_of_word_suffix"] or ""
        pairs = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        self.merges = Merges({(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))})
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner, self.final = [vocab[char[b]] for b in range(256)], [vocab[char[b] + end] for b in range(256)]
        self.special = [t["content"] for t in j["added_tokens"]]

    def count_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(words)
        raw = np.frombuffer(whole.encode(), np.uint8)
        sizes = np.fromiter(map(len, words if len(raw) == len(whole) else map(str.encode, words)), np.int64, len(words))
        flat, last = np.array(self.inner)[raw], np.cumsum(sizes) - 1
        flat[last] = np.array(self.final)[raw[last]]
        return self.merges.merge(flat, sizes)[1], np.ones(len(words), np.int64)


def normalise(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def count(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = spark.sparkContext.broadcast(WordModel(model_path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words, special = lexicon(m, m.count_words), re.compile("|".join(map(re.escape, sorted(m.special, key=len, reverse=True))) or r"(?!)")
        for b in batches:
            raw = b.column(1).to_pylist()
            extra = np.zeros(len(raw), np.int64)
            parts = []
            for i, t in enumerate(raw):
                cut = special.split(t)
                extra[i] = len(cut) - 1
                parts.append(normalise(t) if len(cut) == 1 else "\n".join(map(normalise, cut)))
            ends = np.cumsum([len(p) + 1 for p in parts])
            whole = "\n".join(parts) + "\n"
            codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            first = begins(codes)
            edges = np.flatnonzero(first | (classes()[codes] == SPACE))
            at = np.flatnonzero(first[edges])
            starts = edges[at]
            tokens = list(map(whole.__getitem__, map(slice, starts.tolist(), edges[at + 1].tolist())))
            rows = words.rows(tokens)
            counts = np.r_[0, np.cumsum(words.gather(rows).astype(np.int64))]
            upto = counts[np.searchsorted(starts, ends)]
            n_tokens = np.diff(np.r_[0, upto]) + extra
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in raw], pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
