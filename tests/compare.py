"""Compare a Spark result with its DuckDB counterpart, value by value."""

import datetime
import glob
import os

import duckdb

# DuckDB type -> Spark types that print the same values
TYPES = {
    "BIGINT": {"bigint"},
    "INTEGER": {"int"},
    "DOUBLE": {"double"},
    "VARCHAR": {"string"},
    "BOOLEAN": {"boolean"},
    "TIMESTAMP": {"timestamp_ntz", "timestamp"},
    "DATE": {"date"},
}


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def differences(spark_df, con, sql):
    """Messages, empty when schema and all rows agree."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    theirs = con.execute(sql).fetchall()
    ours = spark_df.collect()
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    for name, kind in spark_df.dtypes:
        if kind not in TYPES.get(kinds[name], set()):
            problems.append(f"type of {name}: {kind} vs {kinds[name]}")
    order = sorted(names)
    a = sorted(tuple(_plain(r[c]) for c in order) for r in ours)
    b = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in theirs)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        problems.append(f"columns {order}: only Spark {only_a} only SQL {only_b}")
    return problems
