"""Compare a registered Spark query with its DuckDB oracle (rows, columns, values)."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def row_hashes(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(hashlib.md5("|".join(_norm(r[i]) for i in order).encode()).hexdigest())
    return sorted(out)


def compare(spark, sf_dir, name, fn, sql, con=None):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        hs, hd = row_hashes(s_cols, s_rows), row_hashes(d_cols, d_rows)
        if hs != hd:
            # show a couple of differing rows
            order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
            order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
            ss = {tuple(_norm(r[i]) for i in order_s) for r in s_rows}
            dd = {tuple(_norm(r[i]) for i in order_d) for r in d_rows}
            problems.append(f"values differ: spark-only {list(ss - dd)[:2]} duck-only {list(dd - ss)[:2]}")
    return problems, len(s_rows)
