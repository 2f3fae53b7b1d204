"""DuckDB side of the comparisons: a query's oracle SQL over frames given as rows."""

import duckdb
import pyarrow as pa

from tools.oracle_check import digest


def duck_rows(sql, **tables):
    """Rows of ``sql`` over arrow tables or Parquet paths."""
    con = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, str):
            con.execute(f"create view {name} as select * from read_parquet('{t}')")
        else:
            con.register(name, t)
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(df, sql, **tables):
    """Whether Spark's rows and types equal DuckDB's."""
    cols, rows = duck_rows(sql, **tables)
    mine = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(cols)
    a, b = digest(df.columns, mine)[1], digest(cols, rows)[1]
    assert a == b, ([x for x in a if x not in b][:3], [x for x in b if x not in a][:3], len(a), len(b))
    return True


def arrow(rows, schema):
    return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
