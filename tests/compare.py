"""Comparison of a query with its SQL on the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool", "date": "date32[day]", "smallint": "int16", "tinyint": "int8"}


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, "nan" if isinstance(v, float) and math.isnan(v) else str(v)) for v in row)


def differences(df, sql: str, con) -> list[str]:
    """What differs: columns, kinds, rows."""
    want = con.sql(sql).to_arrow_table()
    names = sorted(df.columns)
    if names != sorted(want.column_names):
        return [f"columns {names} and {sorted(want.column_names)}"]
    out = []
    kinds = dict(df.dtypes)
    for n in names:
        ours, theirs = KINDS.get(kinds[n], kinds[n]), str(want.schema.field(n).type).replace("large_", "").replace("string_view", "string")
        if ours != theirs:
            out.append(f"{n}: {ours} and {theirs}")
    a = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    b = sorted((tuple(r[n] for n in names) for r in want.select(names).to_pylist()), key=_key)
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    if bad := [(x, y) for x, y in zip(a, b, strict=False) if x != y]:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    if not a:
        out.append("no rows")
    return out
