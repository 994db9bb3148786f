"""Run a query in Spark and its SQL in DuckDB and compare schema kinds, counts and values."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _rows(table) -> list[tuple]:
    """Rows with columns by name, in a canonical order; times without a zone, -0.0 as 0.0."""
    names = sorted(table.column_names)
    cols = []
    for n in names:
        vals = table.column(n).to_pylist()
        if vals and any(isinstance(x, datetime.datetime) for x in vals):
            vals = [x.replace(tzinfo=None) if x is not None else None for x in vals]
        cols.append([x + 0.0 if isinstance(x, float) else x for x in vals])
    return sorted(zip(*cols), key=lambda r: tuple((x is None, str(x)) for x in r))


# Spark type -> DuckDB type
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def compare(sdf, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.to_arrow_table()
    mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    if mine != types:
        return f"schema: spark {mine} sql {types}"
    got = sdf.toArrow()
    if got.num_rows != want.num_rows:
        return f"rows: spark {got.num_rows} sql {want.num_rows}"
    a, b = _rows(got), _rows(want)
    diff = [(x, y) for x, y in zip(a, b) if x != y and repr(x) != repr(y)]
    return f"{len(diff)} rows differ, columns {sorted(mine)}, first {diff[0]}" if diff else None
