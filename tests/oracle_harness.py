"""Run a registered query and its comparison SQL over the same parquet files."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def ordered(names: list[str], rows: list) -> list[tuple]:
    places = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(plain(r[i]) for i in places) for r in rows]
    return sorted(flat, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, name, fn, sql, folder, con=None) -> tuple[int, list[str]]:
    """Row count and the list of differences (empty when equal)."""
    df = fn(spark, folder)
    mine = ordered(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or connect(folder)).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = ordered(names, cur.fetchall())
    faults = []
    if sorted(df.columns) != sorted(names):
        faults.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    if len(mine) != len(theirs):
        faults.append(f"rows {len(mine)} vs {len(theirs)}")
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean"}
    mine_types = dict(df.dtypes)
    for d in cur.description:
        want = kinds.get(str(d[1]))
        if d[0] in mine_types and (want is None or want != mine_types[d[0]]):
            faults.append(f"type of {d[0]}: {mine_types[d[0]]} vs {d[1]}")
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        faults.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return len(mine), faults
