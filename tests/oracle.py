"""Run registered queries beside their SQL statement in DuckDB and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("inf" if math.isinf(v) and v > 0 else v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(df, con, sql) -> str:
    """Empty when equal, else the first difference."""
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    dc, dr = rows_of(names, rel.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}; spark {sr[:2]} sql {dr[:2]}"
    for a, b in zip(sr, dr):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {a} != {b}"
    return "" if sr else "EMPTY"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    mods = [a[1:] for a in argv if a.startswith("@")]
    argv = [a for a in argv if not a.startswith("@")]
    names = [n for n in qs if not argv or any(a in n for a in argv)]
    names = [n for n in names if not mods or qs[n].__module__.split(".")[-1] in mods]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            msg = compare(df, con, sqls[n]) if n in sqls else f"rows only: {len(df.collect())}"
        except Exception as exc:  # noqa: BLE001
            msg = f"ERROR {type(exc).__name__}: {' '.join(str(exc).split())[:400]}"
        fail = msg and not msg.startswith("rows only")
        bad += bool(fail)
        print(f"{'FAIL' if fail else 'ok  '} {n} {time.time() - t:.2f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
