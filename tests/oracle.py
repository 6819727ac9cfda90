"""Holds a query's rows against its SQL, without regard to order."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(df, sql: str, sf_dir: str) -> str | None:
    """None if alike; else what differs."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    found = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(found.columns):
        return f"columns {names} and {sorted(found.columns)}"
    at = [found.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    if got == want:
        return None
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
