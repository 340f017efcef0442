"""Runs registered queries beside their SQL and reports where they differ.

    python tests/oracle.py [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, name, run, sql, sf_dir: str = SF_DIR) -> str | None:
    """None when both sides agree in columns, kinds of value and rows."""
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    kinds = {c: t.simpleString() for c, t in zip(df.columns, [f.dataType for f in df.schema])}
    duck = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (k, duck[c]) for c, k in kinds.items() if k in same and duck[c] != same[k]}
    a, b = _sorted(df.columns, got), _sorted(rel.columns, want)
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return f"{len(a)} vs {len(b)} rows; spark only {sorted(left)[:3]}; sql only {sorted(right)[:3]}"
    if odd:
        return f"types {odd}"
    if not a:
        return "both sides are empty"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from answerloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect()
    prefixes = tuple(sys.argv[1:])
    failed = 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                note = f"no SQL, {run(spark, SF_DIR).count()} rows"
                bad = False
            else:
                diff = differences(spark, con, name, run, sql)
                bad, note = diff is not None, diff or "ok"
        except Exception as error:  # noqa: BLE001
            bad, note = True, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bad
        print(f"{'FAIL' if bad else 'pass'} {time.time() - start:6.2f}s {name}: {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
