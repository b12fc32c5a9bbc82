"""Compare the library's queries with their SQL: python scripts/compare.py [SF_DIR] [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: (round(float(v), 6) if not math.isnan(float(v)) else None) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, name, run, sql, sf_dir):
    began = time.time()
    df = run(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    took = time.time() - began
    if not sql:
        return f"{name}: {len(got)} rows, {took:.1f} s"
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"{name}: DIFFERENT columns {names} {want_names}"
    if got != want:
        first = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
        return f"{name}: DIFFERENT {len(got)} and {len(want)} rows, {first}"
    return f"{name}: equal, {len(got)} rows, {took:.1f} s"


if __name__ == "__main__":
    from harrow.queries import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for n, q in QUERIES.items():
        if not sys.argv[2:] or n in sys.argv[2:]:
            try:
                print(compare(session, con, n, q, ORACLES.get(n), sf), flush=True)
            except Exception as e:  # noqa: BLE001
                print(f"{n}: FAILED {type(e).__name__} {str(e)[:400]}", flush=True)
