"""Run registered queries next to their SQL in DuckDB and compare: `python tests/oracle_check.py [-s SF] [names]`."""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, dt.datetime):
        return ("ts", v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(plain(x) for x in v))
    return (type(v).__name__, v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(ok, message) for one query against its SQL."""
    cols, got = bag(df.columns, df.collect())
    t0 = time.time()
    rel = con.execute(sql)
    wcols, want = bag([d[0] for d in rel.description], rel.fetchall())
    took = time.time() - t0
    n = sum(got.values())
    if cols != wcols:
        return False, f"columns {cols} != {wcols}"
    if got != want:
        more, less = got - want, want - got
        return False, f"{n} vs {sum(want.values())} rows; only spark {list(more)[:2]}; only sql {list(less)[:2]}"
    return True, f"{n} rows, sql {took:.1f}s"


def main() -> int:
    from wardline.session import build
    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("-s", "--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    sf_dir = f"{DATA}/sf{a.sf}"
    spark = build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if a.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                ok, msg = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                ok, msg = True, f"{fn(spark, sf_dir).count()} rows (no SQL)"
        except Exception as exc:  # report and go on to the next query
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24} {time.time() - t0:6.2f}s {msg}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
