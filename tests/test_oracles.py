"""Every core query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from jobs import queries as jobs
from quarry.plans import catalog_queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


QUERIES, SQL = q.QUERIES | jobs.QUERIES, q.SQL | jobs.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(SQL[name])
    named = [d[0] for d in cur.description]
    assert sorted(named) == cols
    assert got == sorted(repr(tuple(plain(r[named.index(c)]) for c in cols)) for r in cur.fetchall())


def test_description_of_quoted_lines(spark, tmp_path):
    texts = ['a token = "55cf"', '"whole"\nmore', "'", "say \"x\"\r\ny", 'x"\u2028', ' "spaced" ', "description: 'd'", "# it's", "plain # one", "", None, '"' * 200]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(q.QUERIES["description"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert [tuple(r) for r in got] == sorted(c.execute(q.SQL["description"]).fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["symbol", "file", "type", "caller_count"] and df.count() > 0
