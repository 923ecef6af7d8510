"""Resolution of records that several sources hold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import similar_titles
from ..plans.tables import saved
from .graph import labels

SIMILAR = 0.86


def _keys() -> Column:
    title = F.concat(F.lit("t:"), "norm")
    return F.array_compact(F.array(F.concat(F.lit("d:"), "doi"), F.concat(F.lit("p:"), "pmid"), F.when(F.length("norm") > 0, title)))


def components(records: DataFrame) -> DataFrame:
    """``seq``, ``component`` of records ``seq``, ``doi``, ``pmid``, ``norm``: linked by any shared key."""
    found = labels(records.select(F.col("seq").alias("node"), F.explode(_keys()).alias("key")))
    return records.select("seq").join(found.withColumnRenamed("node", "seq"), "seq", "left").select("seq", F.coalesce("component", "seq").alias("component"))


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one component in the order of ``seq``.

    A record looks for its strongest key, then its pmid, then its title, each first among strongest keys, then pmids, then
    titles; the first cluster found takes it and fills a missing doi or pmid from it. The cluster then registers its own
    keys as they are now, its first title among them, over whatever they led to before."""
    strong: dict[str, int] = {}
    pmids: dict[str, int] = {}
    titles: dict[str, int] = {}
    held: dict[int, dict[str, str]] = {}
    out = []
    for r in pdf.sort_values("seq").itertuples():
        own = {k: v for k, v in (("doi", r.doi), ("pmid", r.pmid), ("title", r.norm)) if isinstance(v, str) and v}
        named = [f"{k}:{own[k]}" for k in ("doi", "pmid", "title") if k in own]
        hits = (level[key] for key in named for level in (strong, pmids, titles) if key in level)
        cluster = next(hits, r.seq)
        keys = held.setdefault(cluster, dict(own))
        for k in ("doi", "pmid"):
            if k in own:
                keys.setdefault(k, own[k])
        best = next((k for k in ("doi", "pmid", "title") if k in keys), None)
        if best:
            strong[f"{best}:{keys[best]}"] = cluster
        for k, level in (("pmid", pmids), ("title", titles)):
            if k in keys:
                level[f"{k}:{keys[k]}"] = cluster
        out.append((r.seq, cluster))
    return pd.DataFrame(out, columns=["seq", "cluster"])


def clusters(records: DataFrame) -> DataFrame:
    """``seq``, ``cluster`` (seq of its first record). A cluster never reaches beyond a component, so each is folded by itself."""
    keys = saved(records.select("seq", "doi", "pmid", "norm"), "keys")
    of = saved(components(keys), "components")
    several = of.groupBy("component").count().where("count > 1").select("component")
    folded = keys.join(of.join(several, "component", "left_semi"), "seq").groupBy("component").applyInPandas(lambda pdf: _fold(pdf), "seq long, cluster long")
    alone = of.join(several, "component", "left_anti").select("seq", F.col("seq").alias("cluster"))
    return folded.unionByName(alone)


def conflicts(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``cluster``, ``seq``, ``title``, ``doi``) and whether each conflicts with its cluster: its doi is not the first
    one the cluster has; its title is not similar to that of the first record. Titles are compared in partitions of records, not of
    clusters, so that a large cluster is not one task."""
    firsts = rows.groupBy("cluster").agg(F.min_by("title", "seq").alias("first_title"), _first("doi").alias("first_doi"))
    rows = rows.join(firsts, "cluster").repartition("seq")
    other = F.when((F.col("seq") != F.col("cluster")) & (F.col("title") != F.col("first_title")), F.col("title"))
    return rows.withColumns({"doi_conflict": F.coalesce(F.col("doi") != F.col("first_doi"), F.lit(False)), "title_conflict": F.coalesce(~similar_titles("first_title", other, F.lit(SIMILAR)), F.lit(False))})


def _first(c: str) -> Column:
    """The value of the first record that has one; an empty text is none."""
    return F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("seq")))


def filled(rows: DataFrame) -> DataFrame:
    """One row a cluster of records ``seq``, ``cluster``, ``title``, ``doi``, ``pmid``, ``pmcid``, ``year``, ``journal``, ``authors``, ``types``, ``access``,
    ``access_url``, ``flag``, ``source``, ``evidence`` (an array).

    The title is the first record's; other fields and the authors are the first that are there; types are a sorted union; open access
    is sticky, and the last open record after the first brings its address even if it has none, which later records may fill; a flag is
    sticky, else the first that is known counts; evidence is joined in order."""
    later_open = F.max(F.when((F.col("access") == "open") & (F.col("seq") != F.col("cluster")), F.col("seq")))
    url = F.col("access_url").isNotNull() & (F.col("access_url") != "")
    rows = rows.join(rows.groupBy("cluster").agg(later_open.alias("opened")), "cluster")
    counts = url & (F.col("opened").isNull() | (F.col("seq") >= F.col("opened")))
    known = lambda c: F.min_by(c, F.when(F.col(c) != "unknown", F.col("seq")))
    sticky = lambda c, value: F.when(F.bool_or(F.col(c) == value), value).otherwise(F.coalesce(known(c), F.lit("unknown")))
    return rows.groupBy("cluster").agg(
        F.min_by("title", "seq").alias("title"), *(_first(c).alias(c) for c in ("doi", "pmid", "pmcid", "year", "journal")),
        F.min_by("authors", F.when(F.size("authors") > 0, F.col("seq"))).alias("authors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"),
        sticky("access", "open").alias("access"), F.min_by("access_url", F.when(counts, F.col("seq"))).alias("access_url"), sticky("flag", "flagged").alias("flag"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda e: e["evidence"])).alias("evidence"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n"),
    )


def merged(records: DataFrame) -> DataFrame:
    """``filled`` clusters of the records, with how many of their records conflict."""
    rows = saved(records.drop("norm").join(clusters(records), "seq"), "clustered")
    found = conflicts(rows.select("cluster", "seq", "title", "doi")).groupBy("cluster").agg(F.count_if("doi_conflict").alias("doi_conflicts"), F.count_if("title_conflict").alias("title_conflicts"))
    return filled(rows).join(found, "cluster")
