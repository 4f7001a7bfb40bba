"""Compare a Spark result with DuckDB on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(folder, t)}.parquet')")
    return con


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = rows(want_names, cur.fetchall())
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if any(t == "HUGEINT" for t in want_types.values()):
        return f"hugeint in oracle: {want_types}"
    if got != want:
        more, less = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} vs {sum(want.values())} rows; only spark {more}; only sql {less}; {sorted(df.columns)}"
    kinds = {n: t for n, t in df.dtypes}
    family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    odd = {n: (kinds[n], want_types[n]) for n in kinds if family.get(kinds[n], want_types[n]) != want_types[n]}
    return f"types differ {odd}" if odd else None
