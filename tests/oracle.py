"""Compare a registered query with its oracle, the way a row-for-row check would."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall()


def _value(v):
    if isinstance(v, Decimal):
        return float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def mismatch(columns, rows, oracle_columns, oracle) -> str | None:
    if sorted(columns) != sorted(oracle_columns):
        return f"columns {sorted(columns)} vs {sorted(oracle_columns)}"
    mine, theirs = canonical(columns, rows), canonical(oracle_columns, oracle)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}; first {mine[:2]} vs {theirs[:2]}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} vs {b}"
    return None
