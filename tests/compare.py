"""Compare a query's rows with the rows of its SQL, ignoring order."""

from __future__ import annotations

import math
from datetime import datetime, timezone
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime) and value.tzinfo is not None:
        return value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(df, db, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    columns = sorted(df.columns)
    mine = _sorted(df.select(*columns).collect())
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = _sorted([[row[i] for i in order] for row in cursor.fetchall()])
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{dict(zip(columns, a))} != {dict(zip(columns, b))}"
    return None
