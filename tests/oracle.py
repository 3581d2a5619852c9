"""Run queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):  # noqa: ANN001, ANN201
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(cols: list[str], data) -> list[tuple]:  # noqa: ANN001
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, f, sql: str | None, sf_dir: str) -> str:  # noqa: ANN001
    """Empty if equal, else what differs."""
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r.asDict(True).values()) for r in df.collect()])
    if sql is None:
        return ""
    r = tables(sf_dir).execute(sql)
    cols = [d[0] for d in r.description]
    want = rows(cols, r.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if got == want:
        return ""
    diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return f"{len(got)} and {len(want)} rows, {sum(a != b for a, b in zip(got, want))} differ; first {diff}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, sql = e.queries(), e.oracle_sql()
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    bad = 0
    for name in sys.argv[1:] or q:
        for k in [k for k in q if k == name or (name.endswith("*") and k.startswith(name[:-1]))]:
            t = time.time()
            try:
                said = compare(spark, k, q[k], sql.get(k), sf)
            except Exception as x:  # noqa: BLE001
                said = "ERROR " + "\n".join([z for z in str(x).splitlines() if not z.lstrip().startswith("at ")])[-1800:]
            bad += bool(said)
            print(f"{k}: {'ok' if not said else said} {'' if k in sql else '(no SQL)'} {time.time() - t:.1f}s", flush=True)
    print("bad", bad)
