"""Expansion of a record set over citations to saturation, as rounds of joins.

A graph is any pair of tables: links (``src``, ``dst`` as PMIDs, ``dst`` null where the other end has none, ``pos``, ``total``, ``direction`` backward or forward) and core records
(``pmid``, ``doi``, ``title``, ``abstract``). Each round: the frontier's PMIDs, by DOI where one is missing; its neighbours in each direction up to a
limit a paper; less what was seen; up to a cap a round; resolved to records; less those whose other keys were seen, also by an earlier one of the same
round; sorted into relevant and not. Relevant ones are the next frontier. Rounds are written tables, so a lost executor costs a task."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_markup, normalize_doi, normalize_title, record_keys
from ..functions.validate import InvalidInput
from ..operators.graph import labels
from .rules import Rule
from .tables import saved

BACKWARD, FORWARD = "backward", "forward"


@dataclass(frozen=True)
class Limits:
    """Bounds of an expansion; constructing one with bounds that make no sense raises."""

    rounds: int = 5
    per_paper: int = 500
    per_round: int = 5000
    stop_at: int = 0
    directions: tuple[str, ...] = (BACKWARD, FORWARD)

    def __post_init__(self) -> None:
        if min(self.rounds, self.per_paper, self.per_round) < 1 or self.stop_at < 0 or not self.directions or not set(self.directions) <= {BACKWARD, FORWARD}:
            raise InvalidInput("limits must be positive and directions backward or forward")


def matched_text(title, abstract):
    """What a rule is held against: the title, a space, and the cleaned abstract if there is one."""
    return F.concat(title, F.lit(" "), F.coalesce(clean_markup(abstract), F.lit("")))


def _first_of_each(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of records that share keys (``keys``, in the order of ``seq``), those none of whose keys an accepted one before them has. What is left out adds none."""
    taken: set[str] = set()
    kept = []
    for seq, keys in zip(*(pdf.sort_values("seq")[c] for c in ("seq", "keys")), strict=True):
        if not taken & set(keys):
            taken |= set(keys)
            kept.append(seq)
    return pd.DataFrame({"seq": kept})


def accepted(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates (``seq``, ``keys``) without a key in ``seen`` (``key``) and, in order of ``seq``, without one of an accepted candidate before. Only candidates linked by keys are folded together."""
    each = candidates.select("seq", F.explode_outer("keys").alias("key"))
    known = each.join(seen.select("key").distinct(), "key", "left_semi").select("seq").distinct()
    left = saved(candidates.join(known, "seq", "left_anti"), "unseen")
    member = left.select(F.col("seq").alias("node"), F.explode("keys").alias("key"))
    shared = member.join(member.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
    group = labels(shared).withColumnRenamed("node", "seq")
    alone = left.join(group.select("seq"), "seq", "left_anti").select("seq")
    folded = left.select("seq", "keys").join(group, "seq").groupBy("component").applyInPandas(lambda pdf: _first_of_each(pdf), "seq long")
    return left.join(alone.unionByName(folded), "seq", "left_semi")


def expand(seeds: DataFrame, links: DataFrame, core: DataFrame, rule: Rule, limits: Limits = Limits(), already: DataFrame | None = None, resolver: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008  frozen
    """Records that were reached (``round``, ``seq``, ``pmid``, ``doi``, ``title``, ``relevant``) and a log of rounds, whose last row has the reason for the stop.

    ``seeds`` and ``already``: ``pmid``, ``doi``, ``title``; ``resolver``: ``doi``, ``pmid``. Candidates come in the order of paper, direction and link."""
    spark = seeds.sparkSession
    keys = record_keys(F.col("doi"), F.col("pmid"), normalize_title(F.col("title")))
    known = seeds.select("pmid", "doi", "title")
    seen = saved((known if already is None else known.unionByName(already.select("pmid", "doi", "title"))).select(F.explode(keys).alias("key")).distinct(), "seen-keys")
    frontier = saved(known.withColumn("seq", F.row_number().over(Window.orderBy(F.coalesce("pmid", F.lit("")), F.coalesce("doi", F.lit("")), "title")).cast("long")), "frontier")  # a frontier is bounded by the seeds, and by per_round after that
    way = F.array_position(F.array(*map(F.lit, limits.directions)), F.col("direction"))
    found, log, reason = None, [], ""
    for k in range(1, limits.rounds + 1):
        size = frontier.count()
        if not size:
            reason = "frontier_empty"
            break
        if resolver is not None:
            by_doi = resolver.groupBy(normalize_doi(F.col("doi")).alias("r_doi")).agg(F.min("pmid").alias("r_pmid"))
            frontier = frontier.join(by_doi, normalize_doi(F.col("doi")) == F.col("r_doi"), "left").withColumn("pmid", F.coalesce("pmid", "r_pmid")).drop("r_doi", "r_pmid")
        near = links.join(frontier.where("pmid is not null").select(F.col("pmid").alias("src"), F.col("seq").alias("paper")), "src").where((F.col("pos") <= limits.per_paper) & (way > 0))
        near = saved(near.select("paper", "src", way.alias("way"), "direction", "pos", "dst", "total"), "near")
        cut = near.where(F.col("total") > limits.per_paper).select("paper", "way").distinct().count()
        counts = near.agg(F.count_if((F.col("direction") == BACKWARD) & F.col("dst").isNotNull()).alias("backward"), F.count_if((F.col("direction") == FORWARD) & F.col("dst").isNotNull()).alias("forward"), F.count_if(F.col("dst").isNull()).alias("without")).first()
        fresh = near.where("dst is not null").groupBy(F.col("dst").alias("pmid")).agg(F.min(F.struct("paper", "way", "pos")).alias("o"))
        fresh = saved(fresh.join(seen.select(F.expr("substr(key, 6)").alias("pmid")).where(F.col("key").startswith("pmid:")), "pmid", "left_anti"), "fresh")
        n_new = fresh.count()
        if n_new > limits.per_round:  # those beyond the cap stay unseen
            fresh = saved(fresh.orderBy("o").limit(limits.per_round), "fresh-capped")
        order = F.row_number().over(Window.orderBy("o")).cast("long")  # at most per_round rows
        wanted = fresh.select("pmid", order.alias("seq"))
        resolved = saved(wanted.join(core.select("pmid", "doi", "title", "abstract"), "pmid").withColumn("keys", F.array_remove(keys, F.concat(F.lit("pmid:"), "pmid"))), "resolved")
        seen = seen.unionByName(fresh.select(F.concat(F.lit("pmid:"), "pmid").alias("key")))
        new = accepted(resolved, seen).withColumn("matched", matched_text(F.col("title"), F.col("abstract"))).withColumn("relevant", rule.matches(F.col("matched")))
        new = saved(new.select(F.lit(k).alias("round"), "seq", "pmid", "doi", "title", "keys", "relevant"), "accepted")
        seen = saved(seen.unionByName(new.select(F.explode("keys").alias("key"))).distinct(), "seen-keys")
        found = new if found is None else found.unionByName(new)
        n = new.agg(F.count("*").alias("all"), F.count_if("relevant").alias("relevant")).first()
        without_pmid = frontier.where("pmid is null").count()
        total = (log[-1][-2] if log else 0) + n["relevant"]
        log.append((k, size, without_pmid, counts["backward"], counts["forward"], counts["without"], cut, max(0, n_new - limits.per_round), min(n_new, limits.per_round) - resolved.count(), n["all"], n["relevant"], n["all"] - n["relevant"], total, ""))
        if n["relevant"] <= limits.stop_at:
            reason = "saturated"
            break
        frontier = new.where("relevant").select("pmid", "doi", "title", "seq")
    else:
        reason = "round_limit"
    if log:
        log[-1] = (*log[-1][:-1], reason)
    schema = "round int, frontier long, frontier_without_pmid long, backward long, forward long, links_without_pmid long, papers_truncated long, over_budget long, unresolved long, new long, new_relevant long, new_not_relevant long, cumulative_relevant long, stop string"
    rounds = spark.createDataFrame(log, schema)
    empty = spark.createDataFrame([], "round int, seq long, pmid string, doi string, title string, relevant boolean")
    return (empty if found is None else found.drop("keys")), rounds


def work_graph(edges: DataFrame, works: DataFrame) -> DataFrame:
    """Links between PMIDs, in both directions, of a graph whose edges (``src``, ``dst``, ``pos``) join works (``record_id``, ``pmid``); a work without a PMID is a link without one."""
    of = works.select("record_id", "pmid")
    ends = edges.join(of.withColumnsRenamed({"record_id": "src", "pmid": "a"}), "src").join(of.withColumnsRenamed({"record_id": "dst", "pmid": "b"}), "dst", "left")

    def side(one: str, other: str, kind: str) -> DataFrame:
        rows = ends.where(F.col(one).isNotNull()).select(F.col(one).alias("src"), F.col(other).alias("dst"), "pos", F.col("dst" if one == "a" else "src").alias("work"))
        w = Window.partitionBy("src")
        return rows.select("src", "dst", F.row_number().over(w.orderBy("pos", "work")).alias("pos"), F.count("*").over(w).alias("total"), F.lit(kind).alias("direction"))

    return side("a", "b", BACKWARD).unionByName(side("b", "a", FORWARD))


def saturation_svg(rounds: list[tuple[int, int]], title: str = "Saturation", width: int = 640, height: int = 320) -> str:
    """A line of cumulative relevant records by round, as SVG; rounds are few."""
    top = max((n for _, n in rounds), default=0) or 1
    step = (width - 80) / max(1, len(rounds) - 1)
    points = [(40 + i * step, height - 40 - n / top * (height - 80)) for i, (_, n) in enumerate(rounds)]
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in points)
    marks = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3"><title>round {k}: {n}</title></circle>' for (x, y), (k, n) in zip(points, rounds, strict=True))
    label = title.replace("&", "&amp;").replace("<", "&lt;")
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="40" y="24">{label}</text><polyline fill="none" stroke="black" points="{line}"/>{marks}</svg>'


def progress(found: DataFrame, path: str, round_number: int) -> None:
    """Appends a round's relevant records to a tab-separated table."""
    rows = found.where(F.col("relevant") & (F.col("round") == round_number)).select("round", F.coalesce("pmid", F.lit("")).alias("pmid"), F.coalesce("doi", F.lit("")).alias("doi"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"))
    rows.coalesce(1).write.mode("append").option("sep", "\t").csv(path)
