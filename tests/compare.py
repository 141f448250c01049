"""Spark result against its DuckDB counterpart on the same parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if v else 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, text: str, limit: int = 5) -> list[str]:
    cur = con.execute(text)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    got_cols = df.columns
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} != {sorted(want_cols)}"]
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    out = []
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        gs, ws = set(got), set(want)
        out.append(f"cols {sorted(got_cols)}")
        out += [f"spark  {r}" for r in sorted(gs - ws, key=repr)[:limit]]
        out += [f"duckdb {r}" for r in sorted(ws - gs, key=repr)[:limit]]
        if gs == ws and len(got) == len(want):
            out.append("same distinct rows, other multiplicities or value types")
        if not (gs ^ ws) and len(out) == 1:
            out.append(f"types {[type(x) for x in got[0]]} vs {[type(x) for x in want[0]]}")
    return out
