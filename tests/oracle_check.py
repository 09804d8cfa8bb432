"""Compare registered queries with their SQL, row for row and column for column."""

from __future__ import annotations

import math
import time

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}" if float(value) != int(value) else str(int(value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def check(spark, con, name: str, sf_dir: str) -> tuple[str, str]:
    """(status, detail): match, rows-only or mismatch."""
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    mine = df.collect()
    took = f"{time.time() - start:.1f}s, {len(mine)} rows"
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", took
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return "mismatch", f"{took}; columns {sorted(df.columns)} != {sorted(columns)}"
    left, right = bag(df.columns, mine), bag(columns, theirs)
    if left != right:
        only = [x for x in left if x not in set(right)][:2], [x for x in right if x not in set(left)][:2]
        return "mismatch", f"{took}; {len(left)} vs {len(right)} rows; {only}"
    return "match", took
