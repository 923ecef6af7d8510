"""Digests, content identifiers and canonical JSON."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def evidence_id(*fields: Column, prefix: str = "ev-") -> Column:
    """Prefix and 20 hexadecimal digits over the fields; a missing field keeps its place."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256), 1, 20))


def canonical_json(c: Column) -> Column:
    """A JSON string with sorted keys and no spaces."""
    return F.to_json(F.parse_json(c))


def chain_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), payload), 256)


@F.pandas_udf(T.ArrayType(T.StringType()))
def build_chain(payloads: pd.Series) -> pd.Series:
    """Hashes of an ordered array of payloads, each over the hash before it. A fold over built-ins would copy all hashes at each event."""

    def chain(events) -> list[str]:
        out, last = [], GENESIS
        for p in events:
            last = hashlib.sha256(f"{last}|{p}".encode()).hexdigest()
            out.append(last)
        return out

    return payloads.map(lambda events: None if events is None else chain(events))
