"""Every registered query with SQL against that SQL on the smallest tables; the rest by rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = list(SQL)


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith(("date", "str")):
            df[c] = [None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v)[:26].removesuffix(" 00:00:00") for v in df[c]]
            df[c] = df[c].fillna("~")
        else:
            df[c] = df[c].astype(float).round(5)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    got, want = plain(QUERIES[name](spark, SF).toPandas()), plain(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], atol=2e-5, rtol=0, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[0] == "trade_date"
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_over_all_symbols_and_given_texts(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    symbols = {r[0] for r in li.select("l_suppkey").distinct().collect()}
    assert {r[0] for r in QUERIES["src_bars_all"](spark, SF).select("symbol").distinct().collect()} == symbols
    assert {r[0] for r in QUERIES["ing_melt_all"](spark, SF).select("symbol").distinct().collect()} == {f"s{k}" for k in symbols}
    spark.createDataFrame([(1, "<head><TITLE>Demo 2019年年度报告</TITLE>"), (2, "<p>2020 年报</p>"), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, QUERIES["doc_page_titles"](spark, str(tmp_path)).collect())) == [(1, "annual", 2019), (2, None, None), (3, None, None)]
    pages = [(1, "http://e.org/a/b.html?x=1", '<a class="k" href="../c.html#t">c</a> <A HREF=\'/d\'>d</A> <a href="mailto:x@e.org">m</a>'), (2, "http://e.org/c.html", '<a href="http://e.org/a/b.html">b</a><a href="../../up">u</a>'), (3, "http://e.org/x", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, QUERIES["doc_page_links"](spark, str(tmp_path)).collect()))
    assert got == [(1, "../c.html#t", "http://e.org/c.html", True), (1, "/d", "http://e.org/d", False), (2, "../../up", "http://e.org/", False), (2, "http://e.org/a/b.html", "http://e.org/a/b.html", True)]
