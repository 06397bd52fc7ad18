"""Run registered queries next to their SQL and compare all values.

    python -m tests.compare [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        return _plain(value.item())
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE",
}


def compare(df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    relation = con.sql(sql)
    want_columns, want = list(relation.columns), relation.fetchall()
    want_types = dict(zip(want_columns, [str(t) for t in relation.types]))
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    types = []
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind, want_types[name]) != want_types[name]:
            types.append(f"{name}: {kind} != {want_types[name]}")
    if types:
        return "types " + "; ".join(types)
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if a != b:
        ours = sorted((Counter(a) - Counter(b)).elements())
        theirs = sorted((Counter(b) - Counter(a)).elements())
        shown = "\n".join(
            f"   spark {x[:600]}\n   sql   {y[:600]}" for x, y in zip(ours[:3], theirs[:3])
        )
        return f"{len(ours)} of {len(a)} rows differ\n{shown}"
    return ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="sf0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/{args.sf}"
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as driver
    from brightwater.plans.session import local_session

    spark = local_session(8)
    con = connect(folder)
    queries, sql = driver.queries(), driver.oracle_sql()
    names = args.names or list(queries)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                message = compare(df, con, sql[name])
                label = "ok" if not message else "DIFFERS"
            else:
                count = df.count()
                message, label = ("", f"rows only ({count})")
        except Exception as error:
            label, message = "ERROR", "".join(traceback.format_exception_only(error))[:1500]
        if message:
            bad += 1
        print(f"{name:32s} {label:18s} {time.time() - started:6.2f}s", flush=True)
        if message:
            print("   " + message, flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
