"""Run registered queries and their SQL on the same tables and compare rows, names and types."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "float": "FLOAT",
}


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    return str(value)


def compare(spark, con, name, fn, sql, root):
    """None when equal, otherwise a text saying what differs."""
    df = fn(spark, root)
    cols = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got = sorted(tuple(_cell(row[c]) for c in cols) for row in df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    bad = {c: (types[c], kinds[c]) for c in cols if KINDS.get(types[c]) != kinds[c]}
    if bad:
        return f"types {bad}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(_cell(row[i]) for i in at) for row in rel.fetchall())
    if got == want:
        return None if got else "equal but empty"
    left, right = set(got), set(want)
    return (
        f"rows {len(got)} vs {len(want)}\n   cols {cols}\n   spark only {sorted(left - right)[:3]}"
        f"\n   sql only   {sorted(right - left)[:3]}"
    )


def main(argv):
    import __spark_entry__ as entry
    from docketry.session import build_session

    root = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        root, argv = argv[0], argv[1:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), root)
        except Exception as error:  # noqa: BLE001 - report every query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
