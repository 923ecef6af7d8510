"""Operator 3, suffix-array deduplication: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Shorter repetitions are reported beside, not removed: bytes covered by a string of ``PASSAGE`` bytes that also starts elsewhere.

1. Every window of PASSAGE bytes has an anchor, the K-byte gram of least hash in it. Equal windows have equal anchors at
   equal places, so only anchors that occur again matter. The windows of an anchor, each lengthened to LENGTH bytes as far
   as the text goes, lie in one short context.
2. Equal contexts are counted and kept once. Contexts meet by anchor in shards of bounded size; the contexts of an anchor
   with more than ``SPLIT`` occurrences are salted over several shards.
3. In each shard the contexts' suffix array is built by Larsson-Sadakane refinement (groups of equal prefixes are
   sorted again by the ranks twice as far on), Kasai's algorithm gives the common prefixes of neighbours, and windows
   whose neighbours share LENGTH (or PASSAGE) bytes repeat.
4. Of split anchors, each shard publishes one head (a 128-bit digest) of each class of equal windows; shards are merged by
   binary search among the sorted heads.
5. What is found for contexts is carried to every text that has them, and each text drops the union of its repeated windows.

Null text counts as empty. Rows of equal text get equal results, each being a repetition of the other; null and repeated
doc_ids stay as they are. An empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions, texts, written

LENGTH, PASSAGE, K = 400, 256, 64
SPAN = PASSAGE - K + 1
#: Bytes of contexts in a shard, about; occurrences of an anchor that go to one shard.
SHARD, SPLIT = 512 << 10, 1500
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64)
_ODD = _rng.integers(0, 1 << 62, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows, and the first and last start of the windows of each."""
    none = np.zeros(0, np.int64)
    if len(data) < PASSAGE:
        return none, none, none, none
    h, width, level = _BYTE[data], 1, 0
    while width < K:
        h = h[:-width] * _ODD[level] + h[width:]
        width, level = 2 * width, level + 1
    h ^= h >> np.uint64(29)
    h *= _ODD[7]
    h ^= h >> np.uint64(32)
    m = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)  # of equals the leftmost
    width = 1
    while 2 * width <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(h) - SPAN + 1], m[SPAN - width :][: len(h) - SPAN + 1])
    owner = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.r_[first[1:] - 1, len(owner) - 1]
    at = owner[first]
    return at, h[at].view(np.int64), first, last


def suffix_array(codes: np.ndarray, wanted: np.ndarray | None = None, depth: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, int]:
    """Larsson-Sadakane: starts of the suffixes in order (of those ``wanted``, by their first ``depth`` symbols at least); and the ranks, equal where the suffixes share so many symbols, from before the last refinement. codes: small integers, of which 0 separates.

    Groups of suffixes that share a prefix are sorted again by the ranks of what follows the prefix, once and, where three ranks fit
    into a key, twice as far on; those alone in their group are done, and the last refinement is of the wanted ones only."""
    n = len(codes)
    wanted = np.ones(n, bool) if wanted is None else wanted
    found = np.bincount(codes)
    dense = np.cumsum(found > 0).astype(np.uint64)  # symbols by order; 0 is past the end
    width = int(dense[-1]).bit_length()
    h = 62 // width
    wide = np.r_[dense[codes], np.zeros(h, np.uint64)]
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = (key << np.uint64(width)) | wide[i : i + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    bits = n.bit_length() + 1
    further = 2 if 3 * bits <= 63 else 1
    rank = np.full(n + 1, -1, np.int64)  # the last one: past the end
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # of the group of each place
    rank[sa] = start
    known, shared = rank[:n].copy(), h
    place = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in groups that are not sorted yet
    while len(place) and h < depth:
        if h * (further + 1) >= depth:
            known, shared = rank[:n].copy(), h
            place = place[wanted[sa[place]]]
        suffix = sa[place]
        key = start[place]
        for k in range(1, further + 1):
            key = (key << bits) | (rank[np.minimum(suffix + k * h, n)] + 1)
        order = np.argsort(key)
        suffix, key = suffix[order], key[order]
        sa[place] = suffix
        edge = np.r_[True, key[1:] != key[:-1]][: len(key)]
        begin = place[np.maximum.accumulate(np.where(edge, np.arange(len(place)), 0))]
        start[place] = begin
        rank[suffix] = begin
        place = place[~(edge & np.r_[edge[1:], True][: len(edge)])]
        h *= further + 1
    return sa[wanted[sa]], known, shared


def common_prefixes(data: np.ndarray, left: np.ndarray, sa: np.ndarray, known: np.ndarray, shared: int, cap: int = LENGTH, lanes: int = 8192) -> np.ndarray:
    """Kasai: for each place of ``sa``, the bytes its suffix shares with the one before it, at most ``cap`` and not beyond the context's end, ``left`` bytes away.

    The suffixes are cut into lanes, by place in the text, that advance together. A suffix shares one byte less than the suffix of the
    place before it did, where the latter's neighbour leads to one before it; ``shared`` bytes where the ranks ``known`` are equal."""
    n, m = len(data), len(sa)
    wide = np.r_[data, np.zeros(cap + 8, np.uint8)].astype(np.uint64)
    for i in (1, 2, 4):  # eight bytes from each place on
        wide = wide[:-i] | (wide[i:] << np.uint64(8 * i))
    rank = np.full(n + 1, m, np.int64)  # not wanted: after all
    rank[sa] = np.arange(m)
    text = np.sort(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    lanes = max(1, min(lanes, m // 64))
    step = -(-m // lanes)
    at = np.arange(lanes) * step
    end = np.minimum(at + step, m)
    last, via, h = np.full(lanes, -2), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    out = np.zeros(m, np.int32)
    for _ in range(step):
        live = np.flatnonzero(at < end)
        i = text[at[live]]
        j = before[i]
        top = np.where(j >= 0, np.minimum(np.minimum(left[i], left[j]), cap), 0)
        k = np.where((last[live] + 1 == i) & (rank[np.minimum(via[live] + 1, n)] < rank[i]), h[live] - 1, 0)
        k = np.minimum(np.maximum(k, np.where((j >= 0) & (known[i] == known[j]), shared, 0)), top)
        open_ = np.flatnonzero(k < top)
        while len(open_):
            x = wide[i[open_] + k[open_]] ^ wide[j[open_] + k[open_]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            k[open_] += same
            open_ = open_[(same == 8) & (k[open_] < top[open_])]
        k = np.minimum(k, top)
        out[rank[i]] = k
        last[live], via[live], h[live] = i, j, k
        at = at + 1
    return out


def window_classes(contexts: list[bytes], counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ``counts`` windows of each of a shard's contexts: context, start, class by PASSAGE bytes and by LENGTH bytes (-1: the context ends before).

    Equal windows have equal classes."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    codes = data.astype(np.uint16) + np.uint16(1)
    codes[begin + sizes] = 0
    left = np.repeat(begin + sizes, sizes + 1) - np.arange(len(codes))
    count = np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(contexts)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = begin[owner] + start
    wanted = np.zeros(len(codes), bool)
    wanted[at] = True
    sa, known, depth = suffix_array(codes, wanted, LENGTH)
    shared = common_prefixes(data, left, sa, known, depth)
    cls = np.empty(len(codes), np.int64)
    cls[sa] = np.cumsum(shared < PASSAGE)
    short = cls[at]
    cls[sa] = np.cumsum(shared < LENGTH)
    return owner, start, short, np.where(left[at] >= LENGTH, cls[at], -1)


def _digest(b: bytes | memoryview) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(b)
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [anchors(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in b.column("text").to_pylist()]
        offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
        flat = lambda i, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]), kind))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t1"), b.column("t2"), flat(0, pa.int32()), flat(1, pa.int64())], ["doc_id", "t1", "t2", "at", "k"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of the wanted anchors; a task sends each distinct context's bytes once."""
    sent: set = set()
    for b in batches:
        if len(sent) > 1_000_000:
            sent.clear()
        out: list[tuple] = []
        for t1, t2, text, want in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "text", "want")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            many = {w["at"]: w["n"] for w in want}
            for at, k, s, e in zip(*(x.tolist() for x in anchors(np.frombuffer(raw, np.uint8))), strict=True):
                if at in many:
                    ctx, m = raw[s : e + LENGTH], e - s + 1
                    c = _digest(ctx + m.to_bytes(4, "little"))
                    out.append((k, many[at], *c, None if c in sent else ctx, m, t1, t2, s))
                    sent.add(c)
        cols = list(zip(*out, strict=True)) if out else [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.binary(), pa.int32()] + [pa.int64()] * 2 + [pa.int32()], strict=True)], ["k", "n", "c1", "c2", "ctx", "m", "t1", "t2", "s"])


def _packed(*columns: np.ndarray) -> bytes:
    return np.column_stack([c.astype(np.int64) for c in columns]).tobytes()


def _bits(short: np.ndarray, long: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([short, long])).tobytes()


def _shard_rows(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each context the bits of its repeated windows, by PASSAGE and then by LENGTH; and heads of split anchors, packed by the part that merges them. Rows come sorted by anchor and salt."""
    names, kinds = ["c1", "c2", "bits", "part", "heads"], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def shard(rows: list[tuple]) -> list[tuple]:
        owner, start, short, long = window_classes([r[4] for r in rows], [r[5] for r in rows])
        times = np.array([r[6] for r in rows])[owner]
        ends = np.cumsum([r[5] for r in rows]).tolist()
        totals = [np.bincount(short, times)[short], np.where(long >= 0, np.bincount(np.maximum(long, 0), np.where(long >= 0, times, 0))[long], 0)]
        out = []
        for r, e in zip(rows, ends, strict=True):
            found = [t[e - r[5] : e] >= 2 for t in totals]
            if found[0].any():
                out.append((r[2], r[3], _bits(*found), None, None))
        asked = np.array([r[7] for r in rows])[owner]
        for kind, (cls, size) in enumerate(((short, PASSAGE), (long, LENGTH))):
            pick = np.flatnonzero(asked & (cls >= 0))
            if not len(pick):
                continue
            _, head = np.unique(cls[pick], return_index=True)
            head = pick[head]
            at = [(rows[o], s) for o, s in zip(owner[head].tolist(), start[head].tolist(), strict=True)]
            d = np.array([_digest(memoryview(r[4])[s : s + size]) for r, s in at], np.int64)
            c = np.array([r[2:4] for r, _ in at], np.int64)
            n = np.minimum(totals[kind][head], 2)
            to = d[:, 0] % parts
            order = np.argsort(to, kind="stable")
            for k in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                out.append((None, None, None, int(to[k[0]]), _packed(d[k, 0], d[k, 1], c[k, 0], c[k, 1], 2 * start[head[k]] + kind, n[k])))
        return out

    def anchor(rows: list[tuple]) -> list[tuple] | None:
        """Of contexts of one anchor that need no suffix array: each is a copy of another, and no other shard asks."""
        if all(r[6] > 1 and not r[7] for r in rows):
            return [(r[2], r[3], _bits(np.ones(r[5], bool), np.arange(r[5]) + LENGTH <= len(r[4])), None, None) for r in rows]
        return [] if len(rows) == 1 and not rows[0][7] else None

    rows: list[tuple] = []  # of the shard
    same: list[tuple] = []  # of the anchor
    out: list[tuple] = []
    size = 0

    def close() -> None:
        nonlocal size
        plain = anchor(same) if same else []
        if plain is None:
            rows.extend(same)
            size += sum(len(r[4]) for r in same)
        out.extend(plain or [])
        same.clear()

    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("k", "salt", "c1", "c2", "ctx", "m", "n", "split")), strict=True):
            if same and same[0][:2] != r[:2]:
                close()
                if size >= SHARD:
                    out.extend(shard(rows))
                    rows, size = [], 0
            same.append(r)
        yield batch(out)
        out.clear()
    close()
    yield batch(out + (shard(rows) if rows else []))


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that occur once in their shard and again in another, by context. The heads of a part come together."""

    def merged(heads: list[bytes]) -> pa.RecordBatch:
        x = np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 6) for h in heads]) if heads else np.zeros((0, 6), np.int64)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        key = np.ascontiguousarray(x[:, :2]).view([("a", np.int64), ("b", np.int64)]).ravel()
        low, high = np.searchsorted(key, key, "left"), np.searchsorted(key, key, "right")
        upto = np.r_[0, np.cumsum(x[:, 5])]
        found = x[(x[:, 5] == 1) & (upto[high] - upto[low] >= 2)]
        found = found[np.lexsort((found[:, 3], found[:, 2]))]
        first = np.flatnonzero(np.r_[True, (found[1:, 2:4] != found[:-1, 2:4]).any(axis=1)][: len(found)])
        os = pa.ListArray.from_arrays(pa.array(np.r_[first, len(found)], pa.int32()), pa.array(found[:, 4].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(found[first, 2]), pa.array(found[first, 3]), os], ["c1", "c2", "os"])

    part, held = None, []
    for b in batches:
        for p, h in zip(b.column("part").to_pylist(), b.column("heads").to_pylist(), strict=True):
            if p != part and held:
                yield merged(held)
                held = []
            part = p
            held.append(h)
    yield merged(held)


def _spans(starts: np.ndarray, length: int) -> list[dict]:
    """Maximal runs of bytes covered by windows of ``length`` bytes, whose starts are marked."""
    if not starts.any():
        return []
    upto = np.cumsum(np.r_[np.zeros(length, np.int32), starts])
    turn = np.flatnonzero(np.diff(np.r_[False, upto[length:] > upto[:-length], False]))
    return [{"start": s, "end": e} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for b in batches:
        out = []
        for doc_id, text, copies, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "copies", "found")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            n = len(raw)
            if (copies or 1) > 1:
                passages, spans = ([{"start": 0, "end": n}] if n >= size else [] for size in (PASSAGE, LENGTH))
            else:
                starts = np.zeros((2, n), bool)
                for f in found or []:
                    s, m = f["s"], f["m"]
                    if f["bits"]:
                        starts[:, s : s + m] = np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=2 * m).reshape(2, m)
                    for o in f["os"] or ():
                        starts[o % 2, s + o // 2] = True
                passages, spans = (_spans(starts[0], PASSAGE), _spans(starts[1], LENGTH)) if found else ([], [])
            ends = [0, *(x for s in spans for x in (s["start"], s["end"])), n]
            out.append((doc_id, n, spans, passages, b"".join(raw[a:e] for a, e in zip(ends[::2], ends[1::2], strict=True))))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.list_(span), pa.list_(span), pa.binary()], strict=True)], ["doc_id", "n_bytes", "spans", "passages", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs of bytes), ``passages`` (maximal runs that repeat by PASSAGE bytes) and ``kept`` (the bytes outside the spans) of every whole text."""
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions(spark)
    rows = texts(docs).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    of_text = rows.mapInArrow(_anchor_rows, "doc_id long, t1 long, t2 long, at array<int>, k array<long>")
    of_text = written(of_text.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("at").alias("at"), F.first("k").alias("k")), "anchors")
    each = of_text.select("t1", "t2", "doc_id", F.explode(F.arrays_zip("at", "k")).alias("a")).select("t1", "t2", "doc_id", "a.at", "a.k")
    again = written(each.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "repeated")  # a table, so that Spark can split the join of a frequent anchor
    want = each.join(again, "k").groupBy("t1", "t2", "doc_id").agg(F.collect_list(F.struct("at", "n")).alias("want"))
    one = rows.alias("r").join(want.alias("w"), (F.col("r.t1") == F.col("w.t1")) & (F.col("r.t2") == F.col("w.t2")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id"))).select("r.t1", "r.t2", "r.text", "w.want")
    contexts = written(one.mapInArrow(_context_rows, "k long, n long, c1 long, c2 long, ctx binary, m int, t1 long, t2 long, s int"), "contexts")
    shards = F.ceil(F.max("n") / SPLIT)
    distinct = contexts.groupBy("k", "c1", "c2").agg(F.first("ctx", ignorenulls=True).alias("ctx"), F.first("m").alias("m"), F.least(F.count("*"), F.lit(2)).cast("int").alias("n"), shards.alias("shards"))
    distinct = distinct.select("k", F.pmod("c1", "shards").alias("salt"), "c1", "c2", "ctx", "m", "n", (F.col("shards") > 1).alias("split"))
    parts = 8 * n
    found = written(distinct.repartition(n, "k", "salt").sortWithinPartitions("k", "salt").mapInArrow(partial(_shard_rows, parts), "c1 long, c2 long, bits binary, part int, heads binary"), "windows")
    heads = found.where("part is not null").select("part", "heads").repartition(n, "part").sortWithinPartitions("part")
    across = heads.mapInArrow(_merge_rows, "c1 long, c2 long, os array<int>")
    of_context = found.where("bits is not null").select("c1", "c2", "bits", F.lit(None).cast("array<int>").alias("os")).unionByName(across.select("c1", "c2", F.lit(None).cast("binary").alias("bits"), "os"))
    of_context = written(of_context.groupBy("c1", "c2").agg(F.max("bits").alias("bits"), F.flatten(F.collect_list("os")).alias("os")), "of-context")
    places = contexts.select("c1", "c2", "t1", "t2", "s", "m").join(of_context, ["c1", "c2"])
    of_place = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "m", "bits", "os")).alias("found"))
    known = written(of_text.where("copies > 1").select("t1", "t2", "copies").join(of_place, ["t1", "t2"], "full"), "of-text")
    return rows.join(known, ["t1", "t2"], "left").select("doc_id", "text", "copies", "found").mapInArrow(_kept_rows, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, passages array<struct<start:long,end:long>>, kept binary")
