"""Run a registered query and its DuckDB SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import os
from datetime import datetime

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def _plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if isinstance(v, dict):
        return str({k: _plain(x) for k, x in v.items()})
    return str(v)


def _rows(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in table.to_pylist())


def same(spark_df, sql: str, sf_dir: str) -> int:
    names, got = _rows(spark_df.toArrow())
    cur = duck(sf_dir).execute(sql)
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(_plain(dict(zip(cols, r, strict=True))[n]) for n in sorted(cols)) for r in cur.fetchall())
    assert names == sorted(cols), (names, sorted(cols))
    assert len(got) == len(want), (len(got), len(want))
    for x, y in zip(got, want, strict=True):
        assert x == y, (names, x, y)
    return len(got)
