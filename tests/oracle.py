"""Runs a query and its SQL and compares names, kinds and values of their rows."""

from __future__ import annotations

import decimal
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf, f"{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    return tuple(map(plain, x)) if isinstance(x, list) else x


def kind(t) -> str:
    return {"large_string": "string", "date32[day]": "date"}.get(str(t), str(t))


def compare(df, con, sql: str) -> str | None:
    """What differs, or nothing."""
    got, want = df.toArrow(), con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"
    names = sorted(got.column_names)
    kinds = [(n, kind(got.schema.field(n).type), kind(want.schema.field(n).type)) for n in names]
    if bad := [k for k in kinds if k[1] != k[2]]:
        return f"kinds {bad}"
    a, b = (Counter(zip(*[map(plain, x[n].to_pylist()) for n in names], strict=True)) for x in (got, want))
    if a != b:
        return f"{got.num_rows} and {want.num_rows} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
    return None
