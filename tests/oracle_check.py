"""Run queries in Spark and their SQL in DuckDB and compare: rows, names, values.

    python tests/oracle_check.py <sf_dir> [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order) for r in records), key=repr
    )


def compare(spark, con, sf_dir: str, name: str, build, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = build(spark, sf_dir)
    got = df.collect()
    spark_seconds = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spark_seconds:.1f}s"
    start = time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    took = f"{len(got)} rows, spark {spark_seconds:.1f}s, duckdb {time.time() - start:.1f}s"
    left, right = _rows(df.columns, got), _rows(names, want)
    if left == right:
        return True, took
    differing = [(a, b) for a, b in zip(left[1], right[1]) if a != b][:3]
    return False, f"{took}\n  columns {left[0]} / {right[0]}\n  rows {len(got)} / {len(want)}\n  {differing}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from codonlake.session import local_session

    sf_dir, *chosen = sys.argv[1:]
    session, connection = local_session(8), duck(sf_dir)
    failed = []
    for key, build_query in queries().items():
        if chosen and key not in chosen:
            continue
        try:
            ok, text = compare(session, connection, sf_dir, key, build_query, oracle_sql().get(key))
        except Exception as e:  # noqa: BLE001
            ok, text = False, repr(e)[:1500]
        print("ok  " if ok else "FAIL", key, text, flush=True)
        if not ok:
            failed.append(key)
    print("failed:", failed)
