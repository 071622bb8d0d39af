"""Runs a query and its SQL side by side and says where they differ."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(map(_cell, r)) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, in a few lines; empty if nothing does."""
    names = sorted(df.columns)
    got = _sorted([tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect()])
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return [f"columns {names} against {sorted(theirs)}"]
    at = [theirs.index(n) for n in names]
    want = _sorted([tuple(r[i] for i in at) for r in result.fetchall()])
    out = [] if len(got) == len(want) else [f"{len(got)} rows against {len(want)}"]
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return out + ([f"{len(bad)} rows differ, as {bad[0][0]} and {bad[0][1]}"] if bad else [])
