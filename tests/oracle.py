"""Run registered queries beside their SQL twins in DuckDB and compare whole results.

``python -m tests.oracle [--sf DIR] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        if math.isnan(value):
            return (0, "nan")
        return (1, repr(value + 0.0))
    if isinstance(value, bool):
        return (1, str(int(value)))
    return (1, str(value))


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    left = sorted(tuple(cell(v) for v in r) for r in df.select(*names).collect())
    result = con.execute(sql)
    found = [d[0] for d in result.description]
    if sorted(found) != names:
        return f"columns differ: spark {names} sql {sorted(found)}"
    pick = [found.index(n) for n in names]
    right = sorted(tuple(cell(r[i]) for i in pick) for r in result.fetchall())
    if len(left) != len(right):
        return f"rows differ: spark {len(left)} sql {len(right)}"
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        a, b = bad[0]
        diff = [(n, x[1], y[1]) for n, x, y in zip(names, a, b) if x != y]
        return f"{len(bad)} of {len(left)} rows differ, first: {diff} in {[x[1] for x in a]}"
    return f"ok {len(left)}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from riskframe.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            if name in oracles:
                out = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                rows = queries[name](spark, sf_dir).collect()
                out = f"ok (no sql) {len(rows)}"
        except Exception as err:  # noqa: BLE001
            out = f"{type(err).__name__}: {str(err)[:900]}"
        if not out.startswith("ok"):
            failed += 1
        print(f"{name:40s} {time.time() - start:6.1f}s {out}", flush=True)
    print(f"{len(wanted)} run, {failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
