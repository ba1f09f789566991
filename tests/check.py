"""Runs registered queries against DuckDB: python tests/check.py SF_DIR [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.13g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda row: repr(row))


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a message."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    cursor = con.execute(sql)
    names = [item[0] for item in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [row for row in got[1] if row not in set(want[1])][:2]
        lost = [row for row in want[1] if row not in set(got[1])][:2]
        return f"rows {len(got[1])} != {len(want[1])}\n  only spark {extra}\n  only duckdb {lost}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first:\n  spark  {bad[0][0]}\n  duckdb {bad[0][1]}"
    return None if got[1] else "EMPTY (equal)"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from faultline.session import build_session
    import __spark_entry__ as entry

    sf_dir, names = argv[0], argv[1:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in checks:
                message = compare(spark, con, fn, checks[name], sf_dir)
            else:
                message = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            message = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad = message is not None and not message.startswith(("EMPTY", "rows only"))
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:24s} {time.time() - start:6.1f}s {message or ''}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
