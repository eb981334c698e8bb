"""Compare registered queries with their SQL in DuckDB. As a script: python tests/oracle.py [names...]."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


TIMES: dict[str, float] = {}


def session(cores: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("factloom")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [[(None if v != v else round(v, 9) + 0.0) if isinstance(v, float) else v
             for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*cols), key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name: str, folder: str) -> str:
    """'' when equal, else what differs."""
    from factloom.queries import ORACLES, QUERIES
    start = time.time()
    got = QUERIES[name](spark, folder).toArrow()
    TIMES[name] = time.time() - start
    want = con.sql(ORACLES[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    kinds = {n: (_kind(got.schema.field(n).type), _kind(want.schema.field(n).type)) for n in got.column_names}
    bad = {n: k for n, k in kinds.items() if k[0] != k[1]}
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; types {bad}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, e.g. {diff[0]} {sorted(got.column_names)}; types {bad}"
    if bad:
        return f"types {bad}"
    return "" if a else "empty"


def main() -> None:
    from factloom.queries import ORACLES, QUERIES
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    chosen = sys.argv[1:] or list(QUERIES)
    spark, con, failed = session(), duck(folder), 0
    for name in chosen:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, name, folder)
            else:
                n = QUERIES[name](spark, folder).count()
                problem = "" if n else "empty"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {TIMES.get(name, time.time() - start):6.2f}s {'' if name in ORACLES else '(rows only) '}{problem}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} ok")


if __name__ == "__main__":
    main()
