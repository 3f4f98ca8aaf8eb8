"""Compare a Spark result with its SQL counterpart, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(int(value)))
    if isinstance(value, float):
        return (2, "nan" if math.isnan(value) else repr(value + 0.0))
    return (3, str(value))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in data)


def differences(spark_df, con, sql) -> list[str]:
    result = con.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    theirs = rows(theirs_columns, result.fetchall())
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = []
    if sorted(spark_df.columns) != sorted(theirs_columns):
        found.append(f"columns {sorted(spark_df.columns)} / {sorted(theirs_columns)}")
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} / {len(theirs)}")
    found += [f"{a}\n  / {b}" for a, b in zip(ours, theirs) if a != b][:3]
    return found
