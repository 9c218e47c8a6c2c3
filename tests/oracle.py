"""Spark results against DuckDB's, as multisets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def counted(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows; else what differs."""
    relation = con.sql(sql)
    want = counted(relation.columns, relation.fetchall())
    got = counted(df.columns, df.collect())
    if want[0] != got[0]:
        return f"columns {got[0]}, wanted {want[0]}"
    kinds = [{type(v).__name__ for r in c for v in r if v is not None} for c in (got[1], want[1])]
    if got[1] != want[1]:
        return f"{sum(got[1].values())} rows, wanted {sum(want[1].values())}; only here {list((got[1] - want[1]).items())[:3]}, only there {list((want[1] - got[1]).items())[:3]}"
    return "" if kinds[0] == kinds[1] or not got[1] else f"types {kinds[0]}, wanted {kinds[1]}"
