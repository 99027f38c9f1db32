"""Compare a Spark result with a SQL result: same columns, same rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def sql_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def _key(row):
    return tuple((x is None, isinstance(x, str), str(x) if isinstance(x, (str, bool)) else x or 0) for x in row)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=_key)


def differences(spark_df, con, sql, tolerance=0.0):
    """Empty list if both agree, else a few messages."""
    got_columns, got = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_columns, want = normalise([d[0] for d in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)} rows", f"first: {got[:2]} / {want[:2]}"]
    out = []
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if isinstance(a, (int, float)) and isinstance(b, (int, float)):
                same = abs(a - b) <= tolerance * max(1.0, abs(b))
                same = same and type(a) is type(b)
            else:
                same = a == b and type(a) is type(b)
            if not same:
                out.append(f"{g} != {w}")
                break
        if len(out) >= 3:
            break
    return out
