"""Run registered queries on Spark and their checking SQL on DuckDB, and compare.

    python tests/parity.py [--sf DIR] [NAME_PREFIX ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as registered
from ledgerloom.session import build_session
from ledgerloom.sources.adapters import BASE_TABLES


QUERIES, ORACLES = registered.queries(), registered.oracle_sql()


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6))
    if isinstance(v, int):
        return repr(round(float(v), 6)) if abs(v) < 2**53 else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "<null>" if v is None else str(v)


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        return True, f"{len(got)} rows, no checking SQL"
    rel = con.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return False, f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        extra, missing = list(set(got) - set(want))[:3], list(set(want) - set(got))[:3]
        return False, f"{len(got)} rows against {len(want)}; only Spark {extra}; only SQL {missing} (columns {cols})"
    return True, f"{len(got)} rows"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    bad = 0
    for name in QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
