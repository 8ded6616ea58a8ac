"""Compare registered queries with their SQL, as sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def compare(spark, con, query, sql, sf_dir: str) -> list[str]:
    """Differences, empty if columns, rows and values agree."""
    frame = query(spark, sf_dir)
    got = _sorted(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    want = _sorted([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return [f"columns {got[0]} != {want[0]}"]
    problems = []
    if len(got[1]) != len(want[1]):
        problems.append(f"{len(got[1])} rows != {len(want[1])}")
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            problems.append(f"{a} != {b}")
        if len(problems) > 3:
            break
    return problems
