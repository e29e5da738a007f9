"""Run every registered query next to its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("censusloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def rows_of(names, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark: SparkSession, con, query, sql: str | None, sf: str) -> tuple[str, int, float]:
    begin = time.time()
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - begin
    if sql is None:
        return "no sql", len(got[1]), took
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got == want:
        return "ok", len(got[1]), took
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), took
    differing = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:2]
    return f"rows {len(got[1])} != {len(want[1])}: {differing}", len(got[1]), took


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1]
    picked = sys.argv[2:]
    spark, con = session(), duck(sf)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        try:
            verdict, rows, took = compare(spark, con, query, sqls.get(name), sf)
        except Exception as error:  # report and go on with the next query
            verdict, rows, took = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        print(f"{name:28s} {rows:7d} {took:6.2f}s {verdict[:900]}", flush=True)
