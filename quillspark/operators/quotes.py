"""Where quotes occur in texts, by matching all quotes of a bounded part at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of quotes that are matched in one pass over the texts; more quotes take more passes.
PART = 8_000_000
#: Texts a worker holds at once, and their bytes; bytes of texts, or rows, that it gives out at once (a longer text by itself).
BATCH_ROWS, BATCH_BYTES, OUT_BYTES, OUT_ROWS = 512, "8m", 4 << 20, 20_000


def _finder(items: Callable[[], dict[str, list]], with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What finds quotes (to their items) in batches of ``doc_id`` and ``text``: texts repeat once a match, so they are given out in bounded parts, and only where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items()
        words = ahocorasick.Automaton()
        for quote in known:
            words.add_word(quote, quote)
        if known:
            words.make_automaton()
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            rows: list[tuple] = []
            size = 0

            def part(rows, ids=ids, texts=texts) -> pa.RecordBatch:
                at, item, quote, n, first = zip(*rows, strict=True)
                at = pa.array(at, pa.int64())
                found = [ids.take(at), pa.array(item, pa.int64()), pa.array(quote, pa.string()), pa.array(n, pa.int32()), pa.array(first, pa.int64())]
                names = ["doc_id", "item_id", "quote", "n", "at"]
                return pa.RecordBatch.from_arrays([*found, texts.take(at)] if with_text else found, [*names, "text"] if with_text else names)

            for i, cell in enumerate(texts):
                text = cell.as_py()
                for quote in {x for _, x in words.iter(text)} if text and known else ():
                    n, first = text.count(quote), text.find(quote)
                    for item in known[quote]:
                        more = len(text) if with_text else 0
                        if rows and (size + more > OUT_BYTES or len(rows) == OUT_ROWS):
                            yield part(rows)
                            rows, size = [], 0
                        rows.append((i, item, quote, n, first))
                        size += more
            if rows:
                yield part(rows)

    return run


def _found(quotes: DataFrame, docs: DataFrame, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    q = quotes.select("item_id", "quote").where("quote is not null and quote <> ''")
    total = q.agg(F.sum(F.length("quote") + 16)).first()[0] or 0
    n = -(-total // PART)
    out = None
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {quotes.schema['item_id'].dataType.simpleString()}, quote string, n int, at long" + ", text string" * with_text
    for k in range(n):
        rows = q.where(F.pmod(F.xxhash64("quote"), F.lit(n)) == k).collect()  # about PART characters
        of: dict[str, list] = {}
        for r in rows:
            of.setdefault(r["quote"], []).append(r["item_id"])
        known = spark.sparkContext.broadcast(of)
        part = docs.select("doc_id", "text").mapInArrow(_finder(lambda known=known: known.value, with_text), kinds)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], kinds) if out is None else out


def located(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``quote``, ``n`` (occurrences that do not overlap) and ``at`` (the first, from 0) of every quote (``item_id``, ``quote``) in every text (``doc_id``, ``text``) that holds it. Null and empty quotes are in none; quotes of any length count."""
    return _found(quotes, docs, False)


def contained(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``quote`` and ``text`` of what is ``located``: a copy of the text for each match."""
    return _found(quotes, docs, True).select("doc_id", "item_id", "quote", "text")
