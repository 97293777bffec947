"""Run registered queries on Spark and their SQL twins on DuckDB; compare.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Comparison = row count, column names, and the multiset of rows (columns
sorted by name, doubles rounded to 6 places, timestamps to microseconds).
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from barsmith.sources.tables import DRIVER_TABLES  # noqa: E402


EXACT = False


def norm_value(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NaT:
            return None
        if isinstance(v, pd.Timestamp):
            v = v.to_pydatetime()
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if EXACT else round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return norm_value(v.item())
        except Exception:
            pass
    if hasattr(v, "asDict"):
        return norm_value(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm_value(x)) for k, x in v.items()))
    import decimal
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm_value(r[i]) for i in order) for r in rows]


def duck_con(sf_dir):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, q, sf_dir, verbose=False):
    t0 = time.time()
    sdf = q.run(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    sql = q.oracle()
    if sql is None:
        return dict(name=name, status="rows-only", rows=len(srows), spark_s=round(t1 - t0, 2))
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    res = dict(name=name, spark_rows=len(srows), duck_rows=len(drows), spark_s=round(t1 - t0, 2))
    if sorted(scols) != sorted(dcols):
        res["status"] = "SCHEMA"
        res["detail"] = f"spark={sorted(scols)} duck={sorted(dcols)}"
        return res
    a = Counter(rows_of(scols, srows))
    b = Counter(rows_of(dcols, drows))
    if a == b:
        res["status"] = "OK"
    else:
        res["status"] = "VALUES" if len(srows) == len(drows) else "ROWS"
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        res["detail"] = f"cols={sorted(scols)}\n  spark-only={only_s}\n  duck-only={only_d}"
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--exact", action="store_true", help="compare doubles bit for bit")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    global EXACT
    EXACT = a.exact
    from barsmith.plans import load_all
    from barsmith.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    con = duck_con(a.sf)
    bad = 0
    for name, q in reg.items():
        if a.names and name not in a.names:
            continue
        try:
            r = compare(spark, con, name, q, a.sf)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, status="ERROR", detail=str(e)[:1500])
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(r.pop("status"), r.pop("name"), {k: v for k, v in r.items() if k != "detail"}, flush=True)
        if "detail" in r:
            print("   ", r["detail"], flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
