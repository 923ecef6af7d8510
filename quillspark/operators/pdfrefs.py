"""References and citations of documents given as page texts, and how each reference is looked up."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import policy
from ..functions.text import clean_page, expand_citations, matches, normalize_doi, normalize_title, padded, ratios, strip_page_noise, title_similarity

#: The heading of a reference list, what opens an entry, and a group of citations in a body.
HEADING = r"(?im)^\s*(?:references|bibliography|参考文献)\s*$"
MARKER = r"(?m)^\s*\[(\d{1,4})\]\s+"
GROUP = r"\[\s*(\d{1,4}(?:\s*[-–—]\s*\d{1,4})?(?:\s*[,;]\s*\d{1,4}(?:\s*[-–—]\s*\d{1,4})?)*)\s*\]"
#: What a candidate's agreement counts for, and the scores that decide.
WEIGHTS = {"title": 0.65, "author": 0.15, "year": 0.12, "journal": 0.08}


def _heads(text: str | None) -> list[tuple[int, int]]:
    """End of each heading of a page, and the number of the entry that follows on the page (0: none)."""
    import re

    out = []
    for h in re.finditer(HEADING, text or ""):
        m = re.search(MARKER, (text or "")[h.end() :])
        out.append((h.end(), int(m[1]) if m else 0))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("end", T.IntegerType()), T.StructField("next", T.IntegerType())])))
def headings(text: pd.Series) -> pd.Series:
    """Headings of a page by the end of each and the number of the entry that follows; no built-in gives the places of all matches."""
    return text.map(_heads)


def reference_start(pages: DataFrame) -> DataFrame:
    """``doc``, ``page`` and ``end`` of the heading after which entry 1 comes, on its page or first on the next one; documents without such a heading are not there."""
    w = Window.partitionBy("doc").orderBy("page")
    p = pages.select("doc", "page", headings("text").alias("hs"), F.regexp_extract(strip_page_noise(F.col("text")), MARKER, 1).try_cast("int").alias("first"))
    p = p.withColumn("next_first", F.lead("first").over(w)).withColumn("next_page", F.lead("page").over(w))
    here = p.select("doc", "page", "next_first", "next_page", F.explode("hs").alias("h"))
    follows = (F.col("h.next") == 1) | ((F.col("next_page") == F.col("page") + 1) & (F.col("next_first") == 1))
    return here.where(F.coalesce(follows, F.lit(False))).groupBy("doc").agg(F.min(F.struct("page", F.col("h.end").alias("end"))).alias("s")).select("doc", "s.page", "s.end")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("text", T.StringType())])))
def _cut(text: pd.Series) -> pd.Series:
    import re

    def one(t: str | None) -> list[tuple[int, int | None, str]]:
        found = list(re.finditer(MARKER, t or ""))
        ends = [m.start() for m in found[1:]] + [len(t or "")] * bool(found)
        return [(0, None, (t or "")[: found[0].start() if found else None])] + [(m.start() + 1, int(m[1]), t[m.end() : e]) for m, e in zip(found, ends, strict=True)]

    return text.map(one)


def references(pages: DataFrame) -> DataFrame:
    """``doc``, ``number``, ``raw`` and ``page`` of the entries after the heading of each document (``doc``, ``page`` from 1, ``text``); one that runs over pages goes on. Of entries of one number, their texts are joined."""
    start = reference_start(pages).withColumnsRenamed({"page": "s_page", "end": "s_end"})
    p = pages.join(start, "doc").where(F.col("page") >= F.col("s_page"))
    body = F.when(F.col("page") == F.col("s_page"), F.substring("text", F.col("s_end") + 1, F.length("text"))).otherwise(F.col("text"))
    pieces = p.select("doc", "page", F.explode(_cut(strip_page_noise(body))).alias("c")).select("doc", "page", "c.*")
    opened = F.sum(F.col("number").isNotNull().cast("int")).over(Window.partitionBy("doc").orderBy("page", "at"))
    pieces = pieces.withColumn("entry", opened).where("entry > 0")
    one = pieces.groupBy("doc", "entry").agg(F.max("number").alias("number"), F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("page", "at", "text"))).alias("ts"))
    by_number = one.groupBy("doc", "number").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("entry", F.array_join(F.transform("ts", lambda t: t["text"]), " ").alias("t")))).alias("es"))
    return by_number.select("doc", "number", "page", clean_page(F.array_join(F.transform("es", lambda e: e["t"]), " ")).alias("raw"))


def citations(pages: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``number`` and ``context`` of each citation in the body of a document: what comes before its reference heading."""
    start = reference_start(pages).withColumnsRenamed({"page": "s_page", "end": "s_end"})
    p = pages.join(start, "doc").where(F.col("page") <= F.col("s_page"))
    body = F.when(F.col("page") == F.col("s_page"), F.substring("text", F.lit(1), F.col("s_end"))).otherwise(F.col("text"))
    found = p.withColumn("body", body).select("doc", "page", "body", F.posexplode(F.regexp_extract_all("body", F.lit(f"({GROUP})"), F.lit(1))).alias("k", "group"))
    inner = F.regexp_replace("group", r"^\[\s*|\s*\]$", "")
    at = F.instr("body", F.col("group"))
    context = F.substring(clean_page(F.substring("body", F.greatest(at - 120, F.lit(1)), F.length("group") + F.least(at - 1, F.lit(120)) + 120)), 1, 320)
    return found.select("doc", "page", "k", context.alias("context"), F.explode(expand_citations(inner)).alias("number"))


def citation_errors(refs: DataFrame, cited: DataFrame) -> DataFrame:
    """``doc``, ``number`` and ``kind`` (dangling: cited without a reference; uncited: a reference without a citation)."""
    r, c = refs.select("doc", "number").distinct(), cited.select("doc", "number").distinct()
    return c.join(r, ["doc", "number"], "left_anti").withColumn("kind", F.lit("dangling")).unionByName(r.join(c, ["doc", "number"], "left_anti").withColumn("kind", F.lit("uncited")))


def name_token(c: Column) -> Column:
    """The first word of a name."""
    return F.coalesce(F.split_part(normalize_title(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(1)), F.lit(""))


def similarity_or_null(a: Column, b: Column) -> Column:
    """``title_similarity`` of two texts that are there, else null."""
    there = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(there, title_similarity(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def score(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a reference (``r_title``, ``r_author``, ``r_year``, ``r_journal``, ``r_doi``) and a candidate (``c_title``, ``c_author``, ...) with ``score``, its parts and ``decision``."""
    author = F.when((name_token(F.col("r_author")) != "") & (name_token(F.col("c_author")) != ""), (name_token(F.col("r_author")) == name_token(F.col("c_author"))).cast("double"))
    year = F.when(F.col("r_year").isNotNull() & F.col("c_year").isNotNull(), (F.col("r_year") == F.col("c_year")).cast("double"))
    p = pairs.withColumns({"title_score": F.coalesce(similarity_or_null(F.col("r_title"), F.col("c_title")), F.lit(0.0)), "author_score": author, "year_score": year, "journal_score": similarity_or_null(F.col("r_journal"), F.col("c_journal")), "doi_equal": F.coalesce(normalize_doi(F.col("r_doi")) == normalize_doi(F.col("c_doi")), F.lit(False))})
    total = F.when(F.col("doi_equal"), 1.0).otherwise(policy.weighted_score([(w, F.col(f"{k}_score")) for k, w in WEIGHTS.items()]))
    p = p.withColumn("score", F.round(total, 6))
    return p.withColumn("decision", policy.match_decision(F.col("score"), F.col("title_score"), F.col("author_score"), F.col("year_score"), F.col("journal_score"), F.col("doi_equal")))


def block_keys(norm: Column, words: int = 3) -> Column:
    """Keys under which titles that are alike meet: each run of three words of a normalised title (the whole one if shorter)."""
    w = F.split(norm, " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, words), " "))
    return F.filter(F.array_distinct(runs), lambda k: k != "")


#: Pairs of a key up to which they are scored one by one; references and publications of a larger one that meet in one group.
PAIRS, REFS, PUBS = 1024, 4000, 30_000
#: Pairs of a group that are worked on at once: as a table of bounds, and as titles. Pairs of journals that are compared beforehand.
CELLS, BATCH, JOURNALS = 1 << 19, 1 << 16, 20_000


def _round6(x: np.ndarray) -> np.ndarray:
    """As ``F.round``: by the decimal digits where they are near a half."""
    out = np.floor(x * 1e6 + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(x * 1e6 - np.floor(x * 1e6) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _total(title: np.ndarray, author: np.ndarray, year: np.ndarray, journal: np.ndarray) -> np.ndarray:
    """The weighted score before it is rounded, step by step as ``score`` works it out; a part that is not known is NaN."""
    top, weight = 0.0 + title * WEIGHTS["title"], 0.0 + WEIGHTS["title"]
    for w, v in ((WEIGHTS["author"], author), (WEIGHTS["year"], year), (WEIGHTS["journal"], journal)):
        top, weight = top + np.where(np.isnan(v), 0.0, v * w), weight + np.where(np.isnan(v), 0.0, w)
    return top / weight


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a == "") | (b == ""), np.nan, (a == b).astype(float))


def _places(codes: np.ndarray) -> np.ndarray:
    """Bit i of cell (t, c): character i of title t is c."""
    out = np.zeros((len(codes), 256), np.uint64)
    for i in range(min(codes.shape[1], 63)):
        np.bitwise_or.at(out, (np.arange(len(codes)), codes[:, i]), np.uint64(1 << i))
    out[:, :2] = 0  # what fills up
    return out


def _in_order(places: np.ndarray, i: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of titles ``i`` and the titles of ``codes``, at least what difflib matches, for first titles of under 64 characters."""
    v = np.full(len(codes), ~np.uint64(0))
    flat, row = places.ravel(), i * places.shape[1]
    for c in codes.T:
        u = v & flat[row + c]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & ((np.uint64(1) << size[i].astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _unary(codes: list[np.ndarray]) -> list[np.ndarray]:
    """Titles as 0 and 1, so that a product of two counts the characters they share in any order."""
    found = [c for c in np.unique(np.concatenate([np.unique(x) for x in codes])) if c > 1]
    n = [[(x == c).sum(axis=1) for c in found] for x in codes]
    most = [min(y.max(initial=0) for y in each) for each in zip(*n, strict=True)]
    return [np.stack([y >= k + 1 for y, m in zip(each, most, strict=True) for k in range(m)] or [np.zeros(len(x), bool)], axis=1).astype(np.float32) for x, each in zip(codes, n, strict=True)]


def _best_of_group(limit: int, more: tuple[str, ...] = ()) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The pairs of a group that are among the best ``limit`` of a reference by score, then by ``pub``: exactly those, but a title is only compared where its bound may still reach them.

    Bounds come from the characters that titles share, first in any order, then in the same order. Pairs under a reference's ``least`` score are left out."""
    same = ["norm", "author", "year", "journal"]

    def best(r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pub", kind="stable")
        if not len(r) or not len(p):
            return pd.DataFrame({"ref": r["ref"].iloc[:0], "pub": p["pub"].iloc[:0], "score": pd.Series(dtype=float), **{c: r[c].iloc[:0] for c in more}})
        r, key = r.reset_index(drop=True), {c: r[c].iloc[0] for c in more}
        if r["k"].iloc[0].startswith("d:"):  # one DOI: all score 1
            top = p["pub"].iloc[:limit]
            return pd.DataFrame({"ref": r["ref"].repeat(len(top)).to_numpy(), "pub": np.tile(top.to_numpy(), len(r)), "score": 1.0, **key})
        p = p.groupby(same, sort=False).head(limit).reset_index(drop=True)  # of equal ones, the first
        asked = r.groupby(same, sort=False).ngroup().to_numpy()
        q = r.drop_duplicates(same)
        least = np.full(len(q), np.inf)
        np.minimum.at(least, asked, r["least"].fillna(-1.0).to_numpy(float) if "least" in r else np.full(len(r), -1.0))
        x, x_size = padded(q["norm"].tolist(), 0)
        y, y_size = padded(p["norm"].tolist(), 1)
        bits, (x_bits, y_bits) = _places(x), _unary([x, y])
        q_author, q_year, p_author, p_year = (d[c].to_numpy(object) for d in (q, p) for c in ("author", "year"))
        (q_at, q_journal), (p_at, p_journal) = pd.factorize(q["journal"]), pd.factorize(p["journal"])
        p_tails = p[same[1:]].drop_duplicates()
        p_tail = p.groupby(same[1:], sort=False).ngroup().to_numpy()
        exact = len(q_journal) * len(p_journal) <= JOURNALS
        # likeness of journals (NaN: one is not there); where there are many, 1 stands for it until a pair gets so far
        likeness: np.ndarray | None = None
        if exact:
            each = [(a, b) for a in q_journal for b in p_journal]
            likeness = np.where([a == "" or b == "" for a, b in each], np.nan, ratios([a[1:] for a, _ in each], [b[1:] for _, b in each])).reshape(len(q_journal), len(p_journal))

        def journals(i: np.ndarray, j: np.ndarray, compare: bool) -> np.ndarray:
            if likeness is not None:
                return likeness[q_at[i], p_at[j]]
            a, b = q_journal.to_numpy(object)[q_at[i]], p_journal.to_numpy(object)[p_at[j]]
            return np.where((a == "") | (b == ""), np.nan, ratios([t[1:] for t in a], [t[1:] for t in b]) if compare else 1.0)

        def scores(i: np.ndarray, j: np.ndarray, matched: np.ndarray, compare: bool = False) -> np.ndarray:
            title = 2.0 * matched / (x_size[i] + y_size[j])
            return _round6(_total(title, _agree(q_author[i], p_author[j]), _agree(q_year[i], p_year[j]), journals(i, j, compare)))

        def compared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            if y.shape[1] < 200 and x.shape[1] <= 500:
                return scores(i, j, matches(x[i], x_size[i], y[j], y_size[j]), True)
            titles = ratios([q["norm"].iat[k] for k in i], [p["norm"].iat[k] for k in j])
            return _round6(_total(titles, _agree(q_author[i], p_author[j]), _agree(q_year[i], p_year[j]), journals(i, j, True)))

        def in_order(i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
            out, short = shared.astype(np.int64), x_size[i] < 64
            out[short] = _in_order(bits, i[short], x_size, y[j[short]])
            return out

        def ordered(i: np.ndarray, j: np.ndarray, s: np.ndarray, limit: int = limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The best of each reference, in order."""
            by = np.lexsort((j, -s, i))
            i, j, s = i[by], j[by], s[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            return i[place < limit], j[place < limit], s[place < limit]

        out = []
        step = max(1, CELLS // len(p))
        for low in range(0, len(q), step):
            rows = np.arange(low, min(low + step, len(q)))
            tails, at = np.unique(np.array([f"{a}\n{b}\n{c}" for a, b, c in zip(q_author[rows], q_year[rows], q_at[rows], strict=True)], object).astype(str), return_index=True, return_inverse=True)[1:]
            i, j = (z.ravel() for z in np.meshgrid(rows[tails], p_tails.index.to_numpy(), indexing="ij"))
            base = _total(np.zeros(len(i)), *(tail := (_agree(q_author[i], p_author[j]), _agree(q_year[i], p_year[j]), journals(i, j, False))))
            slope = _total(np.ones(len(i)), *tail) - base
            base, slope = (z.reshape(len(tails), -1).astype(np.float32)[:, p_tail] for z in (base, slope))
            bound = x_bits[rows] @ y_bits.T
            shared = bound.astype(np.int16)
            bound *= np.float32(2) / (x_size[rows, None] + y_size).astype(np.float32)
            bound *= slope[at]
            bound += base[at]
            n = min(len(p), limit + 9)
            first = np.argpartition(bound, len(p) - n, axis=1)[:, len(p) - n :]
            i, j = np.repeat(rows, n), first.ravel()
            i, j, _ = ordered(i, j, scores(i, j, in_order(i, j, shared[i - low, j])), limit + 1)
            bound[i - low, j] = -np.inf
            held = ordered(i, j, compared(i, j))
            floor, last = np.full(len(rows), -1.0), np.full(len(rows), len(p))
            full = np.searchsorted(held[0], rows, "right") - np.searchsorted(held[0], rows) == limit
            at_end = np.searchsorted(held[0], rows, "right") - 1
            floor[full], last[full] = held[2][at_end[full]], held[1][at_end[full]]
            higher = least[rows] > floor
            floor[higher], last[higher] = least[rows][higher], len(p)
            i, j = np.nonzero(bound >= (floor - 2e-6).astype(np.float32)[:, None])
            found = [held]
            for cut in range(0, len(i), BATCH):
                a, b = i[cut : cut + BATCH], j[cut : cut + BATCH]
                for finer in (False, True):
                    s = scores(rows[a], b, in_order(rows[a], b, shared[a, b]) if finer else shared[a, b])
                    may = (s > floor[a]) | ((s == floor[a]) & (b < last[a]))
                    a, b = a[may], b[may]
                found.append((rows[a], b, compared(rows[a], b)))
            i, j, s = ordered(*(np.concatenate(z) for z in zip(*found, strict=True)))
            keep = s >= least[i]
            out.append(pd.DataFrame({"u": i[keep], "pub": p["pub"].to_numpy()[j[keep]], "score": s[keep]}))
        found = pd.DataFrame({"u": asked, "ref": r["ref"]}).merge(pd.concat(out), on="u")
        return found[["ref", "pub", "score"]].assign(**key)

    return best


def candidates(refs: DataFrame, publications: DataFrame, limit: int = 5) -> DataFrame:
    """The best ``limit`` candidates of each reference ``ref`` among publications ``pub`` that share a run of title words or the DOI, by score.

    A candidate that is among the best of all is among those of each key it is met by, so of a key with many pairs only these go on. Where a key makes several groups, a reference with author and year
    first meets those that contradict neither; all others of the key only where they could still score as much as the last of its best."""
    from ..plans.tables import saved

    parts = 8 * refs.sparkSession.sparkContext.defaultParallelism
    r = refs.select("ref", *(F.col(c).alias(f"r_{c}") for c in ("title", "author", "year", "journal", "doi")))
    p = publications.select("pub", *(F.col(c).alias(f"c_{c}") for c in ("title", "author", "year", "journal", "doi")))

    def keyed(d, x, name):
        """A row for each key, with what a group compares: the journal's text follows a mark, so that one without letters is not a missing one."""
        d = d.where(F.col(name).isNotNull()).repartition(parts, name).select(F.col(name), F.col(f"{x}_doi"), normalize_title(F.coalesce(f"{x}_title", F.lit(""))).alias("norm"), name_token(F.col(f"{x}_author")).alias("author"), F.coalesce(F.col(f"{x}_year").cast("string"), F.lit("")).alias("year"),
            F.when(F.coalesce(f"{x}_journal", F.lit("")) == "", "").otherwise(F.concat(F.lit("="), normalize_title(F.coalesce(f"{x}_journal", F.lit(""))))).alias("journal"))
        keys = F.concat(F.transform(block_keys(F.col("norm")), lambda k: F.concat(F.lit("t:"), k)), F.coalesce(F.array(F.concat(F.lit("d:"), normalize_doi(F.col(f"{x}_doi")))), F.array().cast("array<string>")))
        return saved(d.withColumn("k", F.explode(keys)).where("k is not null").drop(f"{x}_doi"), "keyed")

    kinds = f"ref {refs.schema['ref'].dataType.simpleString()}, pub {publications.schema['pub'].dataType.simpleString()}, score double"
    split = lambda n_r, n_p: (F.ceil(n_r / REFS).alias("a_n"), F.ceil(n_p / PUBS).alias("b_n"))

    def dealt(d, sizes, on, name, own, other):
        """Each row in its own part of a group, once for each part of the other side."""
        return d.join(sizes, on).withColumn(own, F.pmod(F.xxhash64(name), F.col(f"{own}_n"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_n") - 1))).drop("a_n", "b_n")

    def met(left, right, by, more=()):
        by = [*by, "a", "b"]
        fields = ", ".join([kinds, *(f"{c} string" for c in more)])
        return saved(left.repartition(parts, *by).groupBy(*by).cogroup(right.repartition(parts, *by).groupBy(*by)).applyInPandas(_best_of_group(limit, more), fields), "met")

    rk, pk = keyed(r, "r", "ref"), keyed(p, "c", "pub")
    n = saved(rk.groupBy("k").agg(F.count("*").alias("n_r")).join(pk.groupBy("k").agg(F.count("*").alias("n_p")), "k"), "key-sizes")
    small, large = n.where(F.col("n_r") * F.col("n_p") <= PAIRS).select("k"), saved(n.where(F.col("n_r") * F.col("n_p") > PAIRS), "large-keys")
    pairs = rk.join(small, "k").select("k", "ref").join(pk.select("k", "pub"), "k").select("ref", "pub")
    col, none = F.col, F.lit("")
    # a key is left out where all that have it, of both sides, have one more frequent key
    most = lambda d, name: d.join(large, "k").withColumn("top", F.max(F.struct(col("n_r") * col("n_p"), "k")).over(Window.partitionBy(name))["k"]).groupBy("k").agg(F.min("top").alias("low"), F.max("top").alias("high"))
    inside = most(rk.select("k", "ref"), "ref").unionByName(most(pk.select("k", "pub"), "pub")).groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high and low != k")
    large = saved(large.join(inside, "k", "left_anti"), "large-keys")
    rl, pl = (saved(d.join(large.withColumn("whole", (col("n_r") <= REFS) & (col("n_p") <= PUBS)).select("k", "whole"), "k"), "large") for d in (rk, pk))

    known = rl.where("not whole and k like 't:%' and author != '' and year != ''")
    kin = F.explode(F.array(F.struct("author", "year"), F.struct(col("author"), none.alias("year")), F.struct(none.alias("author"), col("year")), F.struct(none.alias("author"), none.alias("year"))))
    reach = known.groupBy("k", "author", "year").agg(F.count("*").alias("n_r")).withColumn("c", kin).select("k", "author", "year", "n_r", col("c.author").alias("c_author"), col("c.year").alias("c_year"))
    reach = reach.join(pl.where("not whole").groupBy("k", col("author").alias("c_author"), col("year").alias("c_year")).agg(F.count("*").alias("n_p")), ["k", "c_author", "c_year"])
    reach = saved(reach.withColumn("n_r", F.sum("n_r").over(Window.partitionBy("k", "c_author", "c_year"))).select("k", "author", "year", "c_author", "c_year", *split(col("n_r"), col("n_p"))), "reach")
    classes = reach.select("k", "c_author", "c_year", "a_n", "b_n").distinct()
    named = pl.where("not whole").withColumns({"c_author": col("author"), "c_year": col("year")})
    near = met(dealt(known, reach, ["k", "author", "year"], "ref", "a", "b"), dealt(named, classes, ["k", "c_author", "c_year"], "pub", "b", "a"), ["k", "c_author", "c_year"], ("k",))

    least = near.groupBy("k", "ref").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(limit - 1)).alias("least")).groupBy("ref").agg(F.max("least").alias("least"))
    rest = [max(float(_total(np.ones(()), *np.array(x))) for x in ((1, 0, j), (0, 1, j), (0, 0, j), (np.nan, 0, j), (0, np.nan, j))) for j in (np.nan, 1.0)]
    over = F.when(col("journal") == "", rest[0]).otherwise(rest[1]) + 2e-6
    done = F.coalesce(col("k").startswith("t:") & (col("author") != "") & (col("year") != "") & (col("least") > over), F.lit(False))
    open_ = saved(rl.join(least, "ref", "left").where(~done), "open")
    sizes = saved(open_.groupBy("k").agg(F.count("*").alias("n_r")).join(large.select("k", "n_p"), "k").select("k", *split(col("n_r"), col("n_p"))), "open-sizes")
    far = met(dealt(open_, sizes, "k", "ref", "a", "b"), dealt(pl, sizes, "k", "pub", "b", "a"), ["k"])

    pairs = saved(pairs.unionByName(near.select("ref", "pub")).unionByName(far.select("ref", "pub")).distinct(), "pairs")
    scored = score(pairs.join(r, "ref").join(p, "pub"))
    place = F.row_number().over(Window.partitionBy("ref").orderBy(F.col("score").desc(), "pub"))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


def queries(refs: DataFrame) -> DataFrame:
    """Planned searches of each reference (``ref``, ``title``, ``raw``, ``author``, ``year``) in order (``step``): title; author, title and year; author, acronym and year; then the second source by title."""
    title = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(clean_page(F.coalesce("title", "raw")), r"(?i)(?<=\d)(vs)(?=\s|\d)", " $1 "), r'[\[\]"]', " "), r"\s+", " ")), 1, 500)
    acronym = F.regexp_extract(F.coalesce("title", F.lit("")), r"\b([A-Z][A-Z0-9]{3,})\b", 1)
    named = F.col("author").isNotNull() & F.col("year").isNotNull()
    dated = lambda what: F.concat(F.col("author"), F.lit("[Author] AND "), what, F.lit("[Title] AND "), F.col("year").cast("string"), F.lit("[dp]"))
    q = lambda step, source, strategy, text: F.struct(F.lit(step).alias("step"), F.lit(source).alias("source"), F.lit(strategy).alias("strategy"), text.alias("query"))
    steps = F.array_compact(F.array(q(1, "pubmed", "title", F.concat(title, F.lit("[Title]"))), F.when(named, q(2, "pubmed", "author_title_year", dated(title))), F.when(named & (acronym != ""), q(3, "pubmed", "author_acronym_year", dated(acronym))), q(4, "europe_pmc", "title", F.concat(F.lit('TITLE:"'), title, F.lit('"')))))
    return refs.select("ref", F.explode(steps).alias("q")).select("ref", "q.*")


def lookup(refs: DataFrame, search: Callable[[DataFrame], tuple[DataFrame, DataFrame]], limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Best candidates, and how far the search of each reference went: ``execution_status``, ``search_complete``, ``identity_resolved``, ``planned_queries_executed``.

    ``search`` takes queries (``ref``, ``step``, ``query``, ``source``) and gives publications (``ref``, ``pub``, ...) and states (``ref``, ``state``). Each step is made only for references without a
    match of high confidence so far, so there are four joins, whatever the number of references."""
    from ..plans.tables import saved

    plan = saved(queries(refs), "queries")
    open_, found, states = refs.select("ref"), None, None
    for step in (1, 2, 3, 4):
        asked = plan.where(F.col("step") == step).join(open_, "ref", "left_semi")
        pubs, state = search(asked)
        state = asked.select("ref", "step").join(state.select("ref", "state"), "ref", "left").withColumn("state", F.coalesce("state", F.lit("missing")))
        found = pubs if found is None else found.unionByName(pubs)
        states = state if states is None else states.unionByName(state)
        found, states = saved(found, "found"), saved(states, "states")
        r = refs.select("ref", *(F.col(c).alias(f"r_{c}") for c in ("title", "author", "year", "journal", "doi")))
        one = found.groupBy("ref", "pub").agg(*(F.first(c).alias(f"c_{c}") for c in ("title", "author", "year", "journal", "doi")))
        scored = saved(score(one.join(r, "ref")), "scored")
        open_ = refs.select("ref").join(scored.where("decision = 'matched_high_confidence'").select("ref").distinct(), "ref", "left_anti")
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("ref").orderBy(F.col("score").desc(), "pub"))).where(F.col("place") <= limit)
    resolved = best.where("place = 1").select("ref", (F.col("decision") == "matched_high_confidence").alias("identity_resolved"))
    run = states.groupBy("ref").agg(F.count("*").alias("n"), F.bool_and(F.col("state") == "complete").alias("complete"), F.bool_and(F.col("state") == "missing").alias("missing"))
    out = plan.groupBy("ref").agg(F.count("*").alias("planned")).join(run, "ref", "left").join(resolved, "ref", "left").withColumn("identity_resolved", F.coalesce("identity_resolved", F.lit(False)))
    out = out.withColumn("planned_queries_executed", F.coalesce(F.col("n") == F.col("planned"), F.lit(False))).withColumn("search_complete", F.col("planned_queries_executed") & F.coalesce("complete", F.lit(False)))
    status = F.when(F.col("identity_resolved") | F.col("search_complete"), "completed").when(F.coalesce("missing", F.lit(False)), "failed").otherwise("partial")
    return best, out.select("ref", status.alias("execution_status"), "search_complete", "identity_resolved", "planned_queries_executed")


def summary(refs: DataFrame, cited: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row a document: counts of references, citations and lookups (``doc``, ``number``, ``execution_status``, ``best_decision``), and the numbers that dangle or are not cited."""
    odd = citation_errors(refs, cited).groupBy("doc").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("number")))).alias(f"{k}_numbers") for k in ("dangling", "uncited")))
    both = refs.select("doc", "number").distinct().join(cited.select("doc", "number").distinct(), ["doc", "number"]).groupBy("doc").agg(F.count("*").alias("cited_reference_count"))
    a = refs.groupBy("doc").agg(F.count_distinct("number").alias("reference_count"))
    b = cited.groupBy("doc").agg(F.count("*").alias("citation_occurrence_count"))
    kind = lambda k: F.count_if(F.col("execution_status") == k).alias(f"lookup_{k}_count")
    c = lookups.groupBy("doc").agg(F.count("*").alias("lookup_attempted_count"), F.count_if(F.col("best_decision") == "matched_high_confidence").alias("high_confidence_match_count"), kind("completed"), kind("partial"), kind("failed"))
    out = a.join(b, "doc", "left").join(both, "doc", "left").join(c, "doc", "left").join(odd, "doc", "left")
    counts = [x for x in out.columns if x.endswith("_count")]
    none = F.array().cast("array<int>")
    return out.select("doc", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in counts), *(F.coalesce(x, none).alias(x) for x in ("dangling_numbers", "uncited_numbers")))


def result_rows(refs: DataFrame, cited: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row a reference, as written: the reference, where it is cited, and its lookup, pending where there is none. Nothing in it assesses support or claims a reader."""
    at = cited.groupBy("doc", "number").agg(F.array_sort(F.collect_list(F.struct("page", "k", "context"))).alias("citation_occurrences"))
    r = refs.join(at, ["doc", "number"], "left").join(lookups.select("doc", "number", F.struct("execution_status", "best_decision").alias("lookup")), ["doc", "number"], "left")
    pending = F.struct(F.lit("pending").alias("execution_status"), F.lit(None).cast("string").alias("best_decision"))
    return r.select("doc", "number", "raw", "page", F.coalesce("citation_occurrences", F.array().cast(at.schema["citation_occurrences"].dataType)).alias("citation_occurrences"), F.coalesce("lookup", pending).alias("lookup"), F.lit("NOT_ASSESSED").alias("semantic_support_status"), F.lit("NOT_ATTESTED").alias("human_review_status"))
