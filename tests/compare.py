"""Compares a query's rows with those of its SQL in DuckDB."""

import datetime
import decimal
import glob
import os

import duckdb


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v) if isinstance(v, datetime.date) else v


def same_rows(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM read_parquet('{f}')")
    names = sorted(df.columns)
    got = sorted(repr(tuple(norm(v) for v in r)) for r in df.select(*(f"`{n}`" for n in names)).collect())
    found = con.execute(sql)
    own = [d[0] for d in found.description]
    assert sorted(own) == names
    want = sorted(repr(tuple(norm(r[own.index(n)]) for n in names)) for r in found.fetchall())
    assert len(got) == len(want)
    assert got == want
