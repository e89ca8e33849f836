"""Run registered queries and their SQL side by side on one scale factor and report differences.

usage: python tools/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from barloom.plans.catalog import ORACLES, QUERIES
from barloom.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def main() -> int:
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # keep going: one report per query
            print(f"FAIL {name}: {str(e)[:1500]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in ORACLES:
            print(f"rows {name}: {len(rows)} rows, spark {t1 - t0:.2f}s")
            continue
        try:
            res = db.execute(ORACLES[name])
            ocols, orows = canonical([c[0] for c in res.description], res.fetchall())
        except Exception as e:
            print(f"SQLFAIL {name}: {str(e)[:1500]}")
            bad += 1
            continue
        t2 = time.time()
        same = cols == ocols and hashlib.sha1(repr(rows).encode()).digest() == hashlib.sha1(repr(orows).encode()).digest()
        print(f"{'ok  ' if same else 'DIFF'} {name}: {len(rows)}/{len(orows)} rows, spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s")
        if not same:
            bad += 1
            if cols != ocols:
                print("   columns", cols, ocols)
            theirs, ours = set(orows), set(rows)
            only = [r for r in rows if r not in theirs][:4]
            other = [r for r in orows if r not in ours][:4]
            n = sum(a != b for a, b in zip(rows, orows))
            print(f"   {n} differing of {len(rows)}; {cols}")
            for a in only:
                print("   spark", a)
            for b in other:
                print("   sql  ", b)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
