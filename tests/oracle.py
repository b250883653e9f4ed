"""Compare registered Spark queries with their SQL on the same Parquet tables.

    python tests/oracle.py [sf] [query-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if sr else "no rows"
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if sr == dr:
        return None if sr else "no rows"
    only_s = [r for r in sr if r not in set(dr)][:2]
    only_d = [r for r in dr if r not in set(sr)][:2]
    return f"{len(sr)} vs {len(dr)} rows\n   spark {only_s}\n   sql   {only_d}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lineward.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g",
                                                "spark.sql.shuffle.partitions": "8",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on to the next query
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s", diff or "",
              flush=True)
    print("failures:", bad)
