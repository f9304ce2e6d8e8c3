"""Compare registered queries with their SQL counterparts on a folder of tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def compare(frame, con, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    got_types = dict(frame.dtypes)
    relation = con.sql(sql)
    want_types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    problems = []
    if sorted(got_types) != sorted(want_types):
        return [f"columns {sorted(got_types)} != {sorted(want_types)}"]
    for name, kind in got_types.items():
        if KINDS.get(kind, kind) != want_types[name]:
            problems.append(f"type of {name}: {kind} != {want_types[name]}")
    order = sorted(got_types)
    got = sorted(tuple(cell(r[c]) for c in order) for r in frame.select(*order).collect())
    want = sorted(
        tuple(cell(v) for v in row)
        for row in con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall()
    )
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if not got:
        problems.append("no rows")
    different = [(a, b) for a, b in zip(got, want) if a != b]
    if different:
        a, b = different[0]
        problems.append(f"{len(different)} rows differ, first: {str(a)[:300]} != {str(b)[:300]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from mailsift.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            if name in sql:
                problems = compare(query(spark, folder), con, sql[name])
            else:
                n = query(spark, folder).count()
                problems = [] if n else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in sql else "rows")
        print(f"{mark:5}{time.time() - started:6.1f}s {name}", flush=True)
        for p in problems:
            print("      ", p, flush=True)
    missing = set(sql) - set(entry.queries())
    if missing:
        print("SQL without query:", sorted(missing))
    return bad


if __name__ == "__main__":
    sys.exit(main())
