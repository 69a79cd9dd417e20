"""Compare a query with its SQL, as sets of rows with columns in order of name."""

import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def _row(r):
    return tuple("null" if v is None else f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r)


def differences(con, df, sql):
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return [("columns", names, sorted(rel.columns))]
    at = [rel.columns.index(c) for c in names]
    want = sorted(_row([r[i] for i in at]) for r in rel.fetchall())
    got = sorted(_row(r) for r in df.select(*names).collect())
    out = [x for x in zip(got, want) if x[0] != x[1]] + ([("rows", len(got), len(want))] if len(got) != len(want) else [])
    near = lambda a, b: a == b or all(x == y or (_num(x) is not None and _num(y) is not None and abs(_num(x) - _num(y)) <= 2e-5 * max(1, abs(_num(y)))) for x, y in zip(a, b))
    return [x for x in out if len(x) != 2 or not near(*x)]


def _num(x):
    try:
        return float(x)
    except ValueError:
        return None
