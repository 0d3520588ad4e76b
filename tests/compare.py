"""Compares every query with its DuckDB statement on the same files: columns, types, rows and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, f"{float(value):.9g}")
    return (3, str(value))


def same(a, b, tolerance: float = 1e-12) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if type(a) is not type(b):
        return False
    if isinstance(a, float):
        return a == b or math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance) or (math.isnan(a) and math.isnan(b))
    return a == b


def difference(spark_df, db, statement: str) -> str | None:
    """None when equal, else what differs first."""
    relation = db.sql(statement)
    names = sorted(relation.columns)
    if sorted(spark_df.columns) != names:
        return f"columns {sorted(spark_df.columns)} against {names}"
    left = [tuple(r[n] for n in names) for r in spark_df.collect()]
    at = [relation.columns.index(n) for n in names]
    right = [tuple(r[i] for i in at) for r in relation.fetchall()]
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    order = lambda rows: sorted(rows, key=lambda r: [_key(v) for v in r])
    for a, b in zip(order(left), order(right)):
        for n, x, y in zip(names, a, b):
            if not same(x, y):
                return f"{n}: {x!r} against {y!r} in {dict(zip(names, a))} | {dict(zip(names, b))}"
    return None


def run(spark, sf_dir: str, only: str = "") -> int:
    """Prints each outcome."""
    import __spark_entry__ as entry
    db, statements, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and only not in name:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in statements:
                found = difference(df, db, statements[name])
            else:
                found = None if df.count() else "no rows"
        except Exception as e:  # report and go on
            found = f"{type(e).__name__}: {str(e)[:700]}"
        bad += found is not None
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in statements else '(rows only)'} "
              f"{(found or '')[:900]}", flush=True)
    print(f"{bad} differ; {len(entry.queries())} queries, {len(statements)} statements; "
          f"unmatched {set(statements) - set(entry.queries())}")
    return bad


if __name__ == "__main__":
    sys.path[:0] = ["/root/repo", "/root/repo/tests"]
    from conftest import session
    folder, only = (sys.argv[1:] + ["/root/testdata/sf0.01", ""][len(sys.argv) - 1:])[:2]
    run(session(), folder, only)
