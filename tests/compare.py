"""Run registered queries in Spark and their SQL in DuckDB, and compare every value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("thermaweave-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("null",) if math.isnan(v) else ("float", v)
    if isinstance(v, decimal.Decimal):
        return ("decimal", v)
    if isinstance(v, (dt.datetime, dt.date)):
        return ("date", v.isoformat())
    if isinstance(v, list):
        return ("list", tuple(normal(x) for x in v))
    return ("str", str(v))


def rows_of(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(t[i]) for i in order) for t in tuples), key=repr), [names[i] for i in order]


def difference(spark, con, sf_dir: str, name: str, queries, oracles) -> str | None:
    """None when both engines agree exactly, else what differs."""
    df = queries[name](spark, sf_dir)
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return None if got else "no rows"
    cur = con.execute(oracles[name])
    want, want_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(n, a, b) for n, a, b in zip(got_names, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {cells[:4]}"
    return None if got else "both empty"


def main(argv):
    import __spark_entry__ as e

    sf_dir = argv[0]
    spark, con = session(), duck(sf_dir)
    qs, os_ = e.queries(), e.oracle_sql()
    wanted = [q for q in qs if not argv[1:] or any(q.startswith(a) for a in argv[1:])]
    failed = 0
    for q in wanted:
        t = time.time()
        try:
            d = difference(spark, con, sf_dir, q, qs, os_)
        except Exception as ex:  # noqa: BLE001
            d = f"{type(ex).__name__}: {str(ex)[:600]}"
        failed += d is not None
        print(f"{'ok  ' if d is None else 'FAIL'} {q} {time.time() - t:.1f}s {'' if q in os_ else '(rows only)'} {d or ''}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
