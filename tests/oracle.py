"""Compare a query with its SQL counterpart run by DuckDB on the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


def compare(con, sql: str, df) -> str | None:
    """None if equal, else what differs."""
    relation = con.execute(sql)
    duck_columns = [d[0] for d in relation.description]
    want_columns, want = _rows(duck_columns, relation.fetchall())
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if want_columns != got_columns:
        return f"columns {got_columns} instead of {want_columns}"
    if len(want) != len(got):
        return f"{len(got)} rows instead of {len(want)}"
    for w, g in zip(want, got):
        if w != g or [type(v) for v in w] != [type(v) for v in g]:
            return f"row {g} instead of {w}"
    return None
