"""Run registered queries against their SQL on DuckDB: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def frame_rows(columns, rows):
    names = sorted(columns)
    at = [list(columns).index(n) for n in names]
    out = [tuple(repr(r[i]) for i in at) for r in rows]
    return names, sorted(out)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = frame_rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = frame_rows([d[0] for d in cur.description], cur.fetchall())
    return got, want, df


def main():
    from __spark_entry__ import oracle_sql, queries
    from tracelane.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in args[1:] or qs:
        t = time.time()
        try:
            if name not in sqls:
                df = qs[name](spark, sf_dir)
                print(f"rows  {name:24s} {len(df.collect()):8d} {time.time() - t:6.2f}s", flush=True)
                continue
            got, want, df = compare(spark, con, qs[name], sqls[name], sf_dir)
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        ok = got == want
        bad += not ok
        print(f"{'ok   ' if ok else 'DIFF '} {name:24s} {len(got[1]):8d} {time.time() - t:6.2f}s", flush=True)
        if not ok:
            print("   columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
            g, w = set(got[1]), set(want[1])
            print("   only spark ", sorted(g - w)[:4])
            print("   only duckdb", sorted(w - g)[:4])
    print("bad:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
