"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pyarrow as pa


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 9)
    return v


def rows_of(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    out = [tuple(plain(v) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(got: pa.Table, want: pa.Table) -> str:
    """Empty if equal, else what differs first."""
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"
    if got.num_rows != want.num_rows:
        return f"{got.num_rows} and {want.num_rows} rows"
    for a, b in zip(rows_of(got), rows_of(want), strict=True):
        if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    kinds = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in sorted(got.column_names) if str(got.schema.field(n).type) != str(want.schema.field(n).type)]
    return f"types {kinds}" if kinds else ""
