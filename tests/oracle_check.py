"""Run registered queries in Spark and their oracle SQL in DuckDB and
compare row count, column names and an order-insensitive value hash.

    python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    ok_n = len(srows) == len(drows)
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    ok = ok_cols and ok_n and hs == hd
    if verbose:
        print(f"{'OK ' if ok else 'BAD'} {name:28s} rows={len(srows)}/{len(drows)} spark={t1-t0:.2f}s"
              + ("" if ok_cols else f" cols {sorted(scols)} vs {sorted(dcols)}"), flush=True)
        if not ok and ok_cols:
            a, b = set(ls), set(ld)
            for x in list(a - b)[:3]:
                print("   spark only:", x[:300])
            for x in list(b - a)[:3]:
                print("   duck  only:", x[:300])
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    from tessera.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        if name not in os_:
            t0 = time.time()
            try:
                n = fn(spark, sf_dir).count()
                print(f"ROW {name:28s} rows={n} (no oracle) {time.time()-t0:.2f}s", flush=True)
            except Exception as exc:  # noqa: BLE001
                print(f"ERR {name}: {str(exc)[:400]}", flush=True)
                bad.append(name)
            continue
        try:
            if not compare(spark, con, name, fn, os_[name], sf_dir):
                bad.append(name)
        except Exception as exc:  # noqa: BLE001
            print(f"ERR {name}: {str(exc)[:600]}", flush=True)
            bad.append(name)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
