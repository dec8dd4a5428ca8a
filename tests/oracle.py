"""Run queries and their SQL side by side and compare the rows, columns by name."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return float(f"{float(x):.9g}") if not isinstance(x, (list, dict, bytes, tuple)) else repr(x)


def compare(con, df, sql):
    """None, or what differs."""
    names = sorted(df.columns)
    rows = Counter(tuple(cell(x) for x in r) for r in df.select(*names).collect())
    got = con.sql(sql)
    if sorted(got.columns) != names:
        return f"columns {names} and {sorted(got.columns)}"
    at = [got.columns.index(n) for n in names]
    want = Counter(tuple(cell(r[i]) for i in at) for r in got.fetchall())
    return None if rows == want else f"{sum(rows.values())} and {sum(want.values())} rows; only here {list((rows - want).items())[:3]}; only there {list((want - rows).items())[:3]}"
