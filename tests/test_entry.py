"""Driver contract: entry smoke run and oracle agreement on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "xml_md5" in df.columns


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - set(E._corpus()[0])))
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_oracle_sql_needs_no_spark_session():
    """The driver may ask for the oracle SQL in a process without a SparkContext."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import __spark_entry__ as E; own = E._corpus()[0]; o = set(E.oracle_sql()) - set(own); "
            "q = set(E.queries()) - set(own); print(len(o), len(q))")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_oracle, n_queries = map(int, out.stdout.split())
    assert (n_oracle, n_queries) == (40, 41)         # approximate search has no SQL
