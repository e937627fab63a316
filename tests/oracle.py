"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import decimal
import math
import os

import duckdb


def norm(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, norm(v)) for k, v in sorted(x.items()))
    return x


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            p = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, f, sql: str, sf_dir: str) -> tuple[int, list, list]:
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((norm(tuple(r)) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols, (sorted(rel.columns), cols)
    want = sorted((norm(tuple(r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    extra = [r for r in got if r not in set(want)][:5] if got != want else []
    missing = [r for r in want if r not in set(got)][:5] if got != want else []
    assert got == want, (len(got), len(want), extra, missing)
    return len(got), extra, missing
