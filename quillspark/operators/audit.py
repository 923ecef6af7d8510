"""Reconciliation of listed and found items, verification of chained logs, and schema checks compiled to expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import GENESIS, chain_hash

_KINDS = {"string": ("STRING",), "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT"), "boolean": ("BOOLEAN",), "null": ("VOID",)}


def reconcile(listed: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key of either side as ok, changed, missing or unlisted."""
    a = listed.select(F.col(key), F.col(digest).alias("a"))
    b = found.select(F.col(key), F.col(digest).alias("b"))
    return a.join(b, key, "full").select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") != F.col("b"), "changed").otherwise("ok").alias("state"))


def chain_failures(events: DataFrame, log: str) -> DataFrame:
    """``events`` (count), ``first_bad`` (its ``seq``) and ``failure`` of each log of ``seq`` (from 1), ``payload``, ``previous``, ``digest``: a gap or repeat in
    the sequence, a previous hash that is not the one before, or a digest that is not the event's. Null never verifies."""
    w = Window.partitionBy(log).orderBy("seq")
    rows = events.withColumns({"place": F.row_number().over(w), "before": F.lag("digest", 1, GENESIS).over(w)})
    failure = (
        F.when(~F.col("seq").eqNullSafe(F.col("place")), "sequence")
        .when(~F.coalesce(F.col("previous") == F.col("before"), F.lit(False)), "previous_hash")
        .when(~F.coalesce(F.col("digest") == chain_hash(F.col("previous"), F.col("payload")), F.lit(False)), "event_hash")
    )
    rows = rows.withColumn("failure", failure)
    worst = F.min(F.when(F.col("failure").isNotNull(), F.struct("place", "seq", "failure")))
    return rows.groupBy(log).agg(F.count("*").alias("events"), worst.alias("w")).select(log, "events", F.col("w.seq").alias("first_bad"), F.col("w.failure").alias("failure"))


def violations(value: Column, schema: dict, path: str = "$") -> Column:
    """Paths at which a variant breaks a schema (type, required, properties, additionalProperties, enum, const, allOf)."""
    shape = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    there = F.try_variant_get(value, path, "variant").isNotNull()
    found: list[Column] = []
    kind = schema.get("type")
    if kind in _KINDS:
        found.append(F.when(there & ~shape.isin(*_KINDS[kind]), f"{path}: type"))
    elif kind == "number":
        found.append(F.when(there & ~shape.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), f"{path}: type"))
    elif kind in ("object", "array"):
        found.append(F.when(there & ~shape.startswith(kind.upper()), f"{path}: type"))
    for values, name in ((schema.get("enum"), "enum"), ([schema["const"]] if "const" in schema else None, "const")):
        if values is not None:
            found.append(F.when(there & ~F.to_json(F.try_variant_get(value, path, "variant")).isin(*(f'"{v}"' if isinstance(v, str) else str(v).lower() for v in values)), f"{path}: {name}"))
    for name in schema.get("required", ()):
        found.append(F.when(there & F.try_variant_get(value, f"{path}.{name}", "variant").isNull(), f"{path}.{name}: required"))
    if schema.get("additionalProperties") is False:
        names = F.map_keys(F.try_variant_get(value, path, "map<string,variant>"))
        found.append(F.when(there & (F.size(F.array_except(names, F.array(*map(F.lit, schema.get("properties", {}))))) > 0), f"{path}: additional"))
    out = F.array_compact(F.array(F.when(value.isNull(), f"{path}: unreadable") if path == "$" else F.lit(None).cast("string"), *found))
    for name, sub in schema.get("properties", {}).items():
        out = F.concat(out, violations(value, sub, f"{path}.{name}"))
    for sub in schema.get("allOf", ()):
        out = F.concat(out, violations(value, sub, path))
    return out
