"""Keyword rules, compiled to one Boolean Column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEFT, _RIGHT = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def pattern(terms: tuple[str, ...]) -> str:
    """An expression for any of the terms as whole words; ``term*`` is the beginning of one."""
    one = [re.escape(t.rstrip("*").lower()).replace("\\ ", " ") + ("" if t.endswith("*") else _RIGHT) for t in terms]
    return _LEFT + "(" + "|".join(one) + ")"


@dataclass(frozen=True)
class Rule:
    """A text matches if each group has a term in it and no excluded term is, unless a keep_if term is."""

    groups: tuple[tuple[str, ...], ...]
    excludes: tuple[str, ...] = ()
    keep_if: tuple[str, ...] = ()

    @staticmethod
    def parse(groups: list[str], excludes: list[str] = (), keep_if: list[str] = ()) -> Rule:
        split = lambda s: tuple(t.strip() for t in s.split("|") if t.strip())
        found = tuple(g for g in map(split, groups) if g)
        if not found:
            raise ValueError("a rule needs a group of terms")
        out = tuple(dict.fromkeys(t for e in excludes for t in split(e)))
        keep = tuple(t for k in keep_if for t in split(k))
        if keep and not out:
            raise ValueError("keep_if needs terms that exclude")
        return Rule(found, out, keep)

    def included(self, text: Column) -> Column:
        low = F.lower(text)
        out = F.lit(True)
        for g in self.groups:
            out = out & low.rlike(pattern(g))
        return F.coalesce(out, F.lit(False))

    def excluded(self, text: Column) -> Column:
        if not self.excludes:
            return F.lit(False)
        low = F.lower(text)
        hit = low.rlike(pattern(self.excludes))
        return F.coalesce(hit & ~low.rlike(pattern(self.keep_if)) if self.keep_if else hit, F.lit(False))

    def matches(self, text: Column) -> Column:
        return self.included(text) & ~self.excluded(text)
