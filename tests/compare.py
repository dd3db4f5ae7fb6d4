"""Spark's rows against DuckDB's for the registered queries."""

from __future__ import annotations

import math
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str | None:
    """None if both give the same; else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    result = duck(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{len(got)} and {len(want)} rows; first different: {next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)}"
    return None
