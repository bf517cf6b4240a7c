"""Runs registered queries and their SQL on one folder of tables and compares the rows, columns by name."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def difference(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(got)} and {len(want)} rows, {len(bad)} differ; {sorted(names)}: " + " | ".join(f"{str(a)[:400]} <> {str(b)[:400]}" for a, b in bad[:2])


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, sqls, con = entry.queries(), entry.oracle_sql(), duck(sf_dir)
    for name in wanted or [n for n in found if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]:
        t = time.time()
        try:
            said = difference(spark, con, sf_dir, found[name], sqls[name]) if name in sqls else f"no SQL; {found[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001 - the report goes on
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name} {time.time() - t:.1f}s", said or "same", flush=True)
