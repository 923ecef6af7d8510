"""Exports of records as text, one record a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bib_escape, normalize_doi
from ..plans.tables import saved


def _line(tag: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f"{tag}  - "), value.cast("string")))


def ris(title: Column, authors: Column, year: Column, journal: Column, doi: Column, pmid: Column | None = None, abstract: Column | None = None, note: Column | None = None) -> Column:
    """A record in RIS; lines without a value are left out."""
    d = normalize_doi(doi)
    optional = [_line(tag, value) for tag, value in (("AN", None if pmid is None else F.concat(F.lit("PMID:"), pmid)), ("AB", abstract), ("N1", note)) if value is not None]
    lines = [F.lit("TY  - JOUR"), _line("TI", title), F.array_join(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)), "\n"), _line("PY", year), _line("JO", journal), _line("DO", d), _line("UR", F.concat(F.lit("https://doi.org/"), d)), *optional, F.lit("ER  - "), F.lit("")]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def bibtex(key: Column, title: Column, authors: Column, journal: Column, year: Column, doi: Column) -> Column:
    """A record as a BibTeX article; fields without a value are left out."""

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))

    names = F.array_join(F.transform(authors, bib_escape), " and ")
    fields = F.array_compact(F.array(field("title", F.concat(F.lit("{"), bib_escape(title), F.lit("}"))), field("author", names), field("journal", bib_escape(journal)), field("year", year.cast("string")), field("doi", normalize_doi(doi))))
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}\n"))


def numbered(rows: DataFrame, *keys: Column, name: str = "position") -> DataFrame:
    """Rows with their position, from 1, in the order of the keys: dealt by ranges, numbered in each, after the counts of the ranges before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(n, *keys).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("n_"))
    before = sizes.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("before_"))  # a row a range
    at = F.row_number().over(Window.partitionBy("range_").orderBy(*keys)).cast("long")
    return dealt.withColumn("at_", at).join(F.broadcast(before), "range_").withColumn(name, F.col("at_") + F.col("before_")).drop("range_", "at_", "before_")


#: The columns of a screening table, in order.
SCREENING = ("record_id", "title", "abstract", "authors", "year", "journal", "doi", "pmid", "url", "keywords", "origin", "auto_prescreen", "included")


def screening(records: DataFrame) -> DataFrame:
    """Records ``seq``, ``title``, ``abstract``, ``authors``, ``year``, ``journal``, ``doi``, ``pmid``, ``origin``, ``auto_prescreen`` as rows to screen: numbered from 1, nothing included yet."""
    doi = F.coalesce(normalize_doi(F.col("doi")), F.lit(""))
    pmid = F.coalesce("pmid", F.lit(""))
    url = F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).when(pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = records.select("seq", text("title"), text("abstract"), F.array_join("authors", "; ").alias("authors"), F.col("year").cast("int").alias("year"), text("journal"), doi.alias("doi"), pmid.alias("pmid"), url.alias("url"), F.lit("").alias("keywords"), text("origin"), text("auto_prescreen"), F.lit("").alias("included"))
    return numbered(rows, F.col("seq").asc(), name="record_id").select(*SCREENING)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("errorifexists").option("header", True).option("sep", sep).option("quoteAll", sep == ",").csv(path)
