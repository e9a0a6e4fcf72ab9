"""A Spark result against DuckDB's, by columns and by the bag of rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    """A value that is equal in both engines; floats are compared to 9 digits."""
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes, datetime)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(list(v))
    if isinstance(v, dict):
        return plain(list(v.values()))
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    return int(v) if float(v).is_integer() else float(f"{float(v):.9g}")


def bag(rows) -> Counter:
    return Counter(tuple(plain(v) for v in r) for r in rows)


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def same(df, sql: str, sf_dir: str = SF) -> int:
    """Asserts that df and the query give the same rows; how many."""
    names = sorted(df.columns)
    got = bag(df.select(*(f"`{c}`" for c in names)).collect())
    con = connect(sf_dir)
    found = con.execute(sql)
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    rows = found.fetchall()
    at = [have.index(c) for c in names]
    want = bag([r[k] for k in at] for r in rows)
    con.close()
    assert got == want, f"only in Spark: {list((got - want).items())[:3]}; only in DuckDB: {list((want - got).items())[:3]}"
    return sum(got.values())
