"""Validation of arguments and scalar values. What is not proven valid is not: null never passes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA256 = "^[0-9a-f]{64}$"
#: What a name may contain of which a profile must be free, and the names that an archive must not hold.
PROFILE_SECRETS = ("password", "passwd", "secret", "token", "cookie", "session", "apikey", "api_key", "username", "student_id")
ARCHIVE_SECRETS = ("api_key", "apikey", "authorization", "cookie", "email", "mailto", "password", "proxy-authorization", "secret", "token", "access_token", "webenv")


class InvalidInput(ValueError):
    """A plan or an input breaks a rule that the caller must mend; data that breaks one becomes an issue row instead."""


class Unavailable(RuntimeError):
    """A lookup has no archived answer, or the answer is not a success."""


class IntegrityError(ValueError):
    """A log, cache or manifest does not agree with its digests."""


def paging(limit: int | None, page_size: int, most: int | None = None) -> int:
    """The page size to use; raises if either argument is not positive, or if the limit exceeds ``most`` (which also demands one)."""
    if page_size < 1 or (limit is not None and limit < 1):
        raise InvalidInput("limit and page_size must be positive")
    if most is not None and (limit is None or limit > most):
        raise InvalidInput(f"a limit of at most {most} is required")
    return page_size if limit is None else min(page_size, limit)


def selector(text: str, widest: int = 1000) -> list[int]:
    """Numbers of a selection such as ``1,3,10-20``, ascending, each once."""
    out: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        found = re.fullmatch(r"([1-9][0-9]*)(?:-([1-9][0-9]*))?", part)
        if not found:
            raise InvalidInput(f"not a number or a range: {part!r}")
        low, high = int(found[1]), int(found[2] or found[1])
        if not 0 <= high - low <= widest:
            raise InvalidInput(f"a range must ascend and span at most {widest}: {part!r}")
        out.update(range(low, high + 1))
    return sorted(out)


def timestamp(c: Column) -> Column:
    """Whether a text is an ISO-8601 time with its zone."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(shape & F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")).isNotNull(), F.lit(False))


def sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(SHA256), F.lit(False))


def status_metadata(retrieved_at: Column, digest: Column, url: Column) -> Column:
    """Whether a status lookup carries all its evidence: a time, a digest and an address."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    return there(retrieved_at) & sha256(digest) & there(url)


def _tree_keys(json: Column) -> Column:
    """The names of a JSON document's members at any depth: strings that a colon follows outside any string."""
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    names = F.filter(tokens, lambda t: t.rlike(r":$"))
    return F.transform(names, lambda t: F.regexp_replace(F.regexp_replace(t, r"\s*:$", ""), r'^"|"$', ""))


def forbidden_keys(json: Column, parts: tuple[str, ...] = PROFILE_SECRETS, whole: bool = False) -> Column:
    """Names anywhere in a JSON document that hold one of ``parts`` (or, if ``whole``, are one); null for what is not JSON."""
    low = lambda k: F.lower(k) if whole else F.replace(F.lower(k), F.lit("-"), F.lit("_"))
    bad = (lambda k: low(k).isin(*parts)) if whole else (lambda k: low(k).rlike("|".join(parts)))
    return F.when(F.try_parse_json(json).isNotNull(), F.filter(_tree_keys(json), bad))


def outcome_error(execution: Column, match: Column) -> Column:
    """Why a lookup's outcome breaks its contract, or null: a failed one claims no match, any other ended one must say which."""
    return (
        F.when(~F.coalesce(execution.isin("completed", "partial", "failed"), F.lit(False)), "status must be completed, partial or failed")
        .when((execution == "failed") & match.isNotNull(), "a failed lookup has no match status")
        .when((execution != "failed") & ~F.coalesce(match.isin(*MATCHES), F.lit(False)), "a match status is required")
    )


#: What a lookup may say of its best candidate.
MATCHES = ("matched_high_confidence", "candidate_requires_review", "not_matched")


def actor_error(actor: Column, role: Column, statement: Column, shortest: int, explicit: Column) -> Column:
    """Why an attestation or rescission is refused, or null: it takes an explicit command, a claimed human, an anonymous role and a statement."""
    low = F.lower(F.trim(role))
    words = F.trim(F.regexp_replace(statement, r"\s+", " "))
    return (
        F.when(~F.coalesce(explicit, F.lit(False)), "explicit_command")
        .when(~F.coalesce(F.lower(F.trim(actor)) == "human", F.lit(False)), "actor_type")
        .when(~F.coalesce(low.rlike(r"^anonymous_[a-z0-9]+(_[a-z0-9]+)*$") & (F.length(low) <= 80), F.lit(False)), "reviewer_role")
        .when(~F.coalesce(F.length(words) >= shortest, F.lit(False)), "statement")
    )
