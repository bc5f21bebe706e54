"""Run every registered query in Spark and its DuckDB oracle; report matches.

usage: python scripts/check_oracle.py [sf_dir] [name-substring ...]
"""
import sys
import time

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

from shipwise.catalog import oracle_sql, queries  # noqa: E402
from shipwise.oracle.compare import compare, duck_connect  # noqa: E402
from shipwise.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = local_session(8, 8)
    con = duck_connect(sf)
    qs, sql = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        df = fn(spark, sf)
        if name in sql:
            ok, msg = compare(df, con, sql[name])
        else:
            ok, msg = True, f"no oracle; {df.count()} rows"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:40s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print(f"{len(qs) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main()
