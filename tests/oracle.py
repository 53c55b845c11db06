"""Run registered queries against their SQL in DuckDB and compare whole results.

python -m tests.oracle [pattern] [sf] [hot_rows]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8", **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 9) + 0.0
    if isinstance(v, bool):
        return ("bool", v)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    idx = [names.index(n) for n in sorted(names)]
    return sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)


def kind(v) -> str:
    return type(v).__name__ if v is not None else "null"


def compare(spark, con, name: str, sf: str) -> str | None:
    """None when equal, else what differs."""
    from stepfold.suite import ORACLES, QUERIES

    df = QUERIES[name](spark, f"{DATA}/sf{sf}")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if got else "no rows"
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; e.g. {got[:2]} / {want[:2]}"
    if not got:
        return "no rows on either side"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w}"
        if [kind(x) for x in g] != [kind(x) for x in w]:
            return f"types differ: {[kind(x) for x in g]} {[kind(x) for x in w]}"
    return None


def main(pattern: str = "", sf: str = "0.01", hot: str = "") -> None:
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from stepfold.plans.session import configure
    from stepfold.suite import ORACLES, QUERIES

    spark = configure(session())
    if hot:
        spark.conf.set("stepfold.hotRows", hot)
    con = duck(sf)
    bad = 0
    for name in QUERIES:
        if not any(p in name for p in pattern.split(",")):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += diff is not None
        mark = "ok  " if diff is None else "FAIL"
        print(mark, name, "" if name in ORACLES else "(rows)", f"{time.time() - t:.2f}s", diff or "", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
