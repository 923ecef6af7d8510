"""Byte-pair merges in numpy: all words of a batch advance together, one merge in each word and round."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

_NONE = np.int64(1 << 62)


class Merges:
    """Pairs of symbols that merge: their ranks (lower first; equal ranks go left to right) and what they become."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        left = np.fromiter((a for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((b for _, b in pairs), np.int64, len(pairs))
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _NONE)
        values = list(pairs.values())
        self.rank = np.append(np.array([v[0] for v in values], np.int64)[order], 0) if values else np.zeros(1, np.int64)
        self.made = np.append(np.array([v[1] for v in values], np.int64)[order], 0) if values else np.zeros(1, np.int64)
        self.pairs = pairs

    #: Words of more symbols than this are merged by a heap: a round merges one pair of a word, so rounds would be as many as its symbols.
    LONG = 256

    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words laid end to end, with their sizes, when no pair that merges remains; in the same form."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if not (long := np.flatnonzero(sizes > self.LONG)).size:
            symbols, owner = self._rounds(flat, owner)
        else:
            ends = np.cumsum(sizes)
            made = [self._heap(flat[ends[i] - sizes[i] : ends[i]].tolist()) for i in long]
            short = sizes[owner] <= self.LONG
            symbols, owner = self._rounds(flat[short], owner[short])
            symbols, owner = np.concatenate([symbols, *made]), np.concatenate([owner, np.repeat(long, [len(x) for x in made])])
            order = np.argsort(owner, kind="stable")
            symbols, owner = symbols[order], owner[order]
        return symbols, np.bincount(owner, minlength=len(sizes))

    def _rounds(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_s, done_o = [], []
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.searchsorted(self.keys, key)
            hit = (self.keys[at] == key) & (owner[1:] == owner[:-1])
            place = np.full(len(sym), _NONE)
            place[:-1][hit] = (self.rank[at[hit]] << 32) | np.flatnonzero(hit)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(place, first)  # the lowest rank of each word, leftmost
            ended = least == _NONE
            if ended.any():
                gone = np.repeat(ended, np.diff(np.r_[first, len(sym)]))
                done_s.append(sym[gone])
                done_o.append(owner[gone])
            else:
                gone = np.zeros(len(sym), bool)
            pos = least[~ended] & 0xFFFFFFFF
            sym[pos] = self.made[at[pos]]
            gone[pos + 1] = True
            sym, owner = sym[~gone], owner[~gone]
        if not done_s:
            return sym, owner
        symbols, owners = np.concatenate(done_s), np.concatenate(done_o)
        order = np.argsort(owners, kind="stable")
        return symbols[order], owners[order]

    def _heap(self, word: list[int]) -> np.ndarray:
        sym, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list = []

        def add(i: int) -> None:
            if i >= 0 and after[i] < len(sym) and (p := self.pairs.get((sym[i], sym[after[i]]))):
                heapq.heappush(heap, (p[0], i, sym[i], sym[after[i]]))

        for i in range(len(sym)):
            add(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] == a else len(sym)
            if j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = self.pairs[a, b][1], -1, after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            add(before[i])
            add(i)
        return np.array([s for s in sym if s >= 0], np.int64)


def lexicon(model: object, encode: Callable) -> Lexicon:
    """The words that this worker has encoded with ``model``, kept beside it from task to task."""
    if not hasattr(model, "lexicon"):
        model.lexicon = Lexicon(encode)
    return model.lexicon


class Lexicon:
    """Words already encoded by a worker, as rows of flat arrays. At ``limit`` words it starts afresh, which costs time only."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = 0

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.row) > self.limit:
            self._clear()
        row = self.row
        if new := list(dict.fromkeys(w for w in words if w not in row)):
            made, sizes = self.encode(new)
            at, total = len(row), len(made)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while at + len(new) > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.flat[self.used : self.used + total] = made
            self.start[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[at : at + len(new)] = sizes
            self.used += total
            row.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The symbols of these words, one after another."""
        size = self.size[rows].astype(np.int64)
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[rows] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
