"""Each query against its SQL in another engine, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillspark.plans import registry as catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if pd.isna(x):
            return None
        return bool(x) if "bool" in type(x).__name__ else float(x) if not isinstance(x, str) else x

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    rows = catalogue.flagship(spark, SF).collect()
    assert sum(r.held for r in rows) == 200


def test_clean_text_decodes_what_its_sql_does(spark, tmp_path):
    """Pages cut inside a reference, references that the SQL leaves alone, and white space that it keeps."""
    pages = ["<p>a &amp; b</p> &copy", "cut &amp", "&amp;lt; &eacute;&#65; &lt;x", "a &nbsp;b\x0b\x0cc", None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(catalogue.QUERIES["q_clean_text"](spark, str(tmp_path)).toPandas()) == rows(con.sql(catalogue.SQL["q_clean_text"]).df())
