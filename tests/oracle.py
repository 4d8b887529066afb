"""Compare a query with its SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same_rows(df, con, sql: str) -> None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    theirs = Counter(tuple(_plain(dict(zip(names, row))[c]) for c in sorted(names)) for row in result.fetchall())
    ours = Counter(tuple(_plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
