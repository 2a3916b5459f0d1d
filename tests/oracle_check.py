"""Run queries() against oracle_sql() the way the driver does, and report per key.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tessera.sources.tables import TABLE_NAMES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "int"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, str):
        return "str"
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return "list"
    return type(v).__name__


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    msgs = []
    if sorted(spark_cols) != sorted(duck_cols):
        return False, [f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"]
    order_s = [spark_cols.index(c) for c in sorted(spark_cols)]
    order_d = [duck_cols.index(c) for c in sorted(duck_cols)]
    if len(spark_rows) != len(duck_rows):
        msgs.append(f"rows differ: {len(spark_rows)} vs {len(duck_rows)}")
    for i, c in enumerate(sorted(spark_cols)):
        ks = {_kind(r[order_s[i]]) for r in spark_rows} - {None}
        kd = {_kind(r[order_d[i]]) for r in duck_rows} - {None}
        if ks and kd and ks != kd:
            msgs.append(f"type of {c}: {ks} vs {kd}")
    a = sorted(tuple(_norm(r[j]) for j in order_s) for r in spark_rows)
    b = sorted(tuple(_norm(r[j]) for j in order_d) for r in duck_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        msgs.append(f"values differ, e.g. {diff}")
    return not msgs, msgs


def plain_session():
    """A session configured like the driver's: nothing but master and shuffle partitions."""
    from pyspark.sql import SparkSession
    s = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8") \
        .config("spark.ui.enabled", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def run(sf_dir: str, keys: list[str] | None = None, spark=None) -> dict:
    from tessera.session import build_session
    spark = spark or (plain_session() if os.environ.get("PLAIN_SESSION") else build_session())
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
        except Exception as e:  # noqa: BLE001
            out[k] = ("SPARK-ERROR", str(e)[:400])
            print(k, "SPARK-ERROR", str(e)[:400], flush=True)
            continue
        if k not in sqls:
            out[k] = ("rows-only", len(rows))
            print(f"{k}: rows-only {len(rows)} rows  spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            out[k] = ("SQL-ERROR", str(e)[:400])
            print(k, "SQL-ERROR", str(e)[:400], flush=True)
            continue
        ok, msgs = compare(rows, cols, drows, dcols)
        out[k] = ("OK" if ok else "MISMATCH", msgs)
        print(f"{k}: {'OK' if ok else 'MISMATCH'} {len(rows)} rows  spark {t1 - t0:.1f}s  "
              f"duck {time.time() - t1:.1f}s {msgs}", flush=True)
    return out


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    ks = sys.argv[2:] or None
    res = run(sf, ks)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "rows-only")]
    print("SUMMARY", len(res), "checked;", len(bad), "failing:", bad)
