"""Runs queries beside their SQL twins: python tests/compare.py [--sf DIR] [NAME...]. Prints what differs."""

import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).iterdir()):
        if p.suffix == ".parquet":
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def cell(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v).lower() if isinstance(v, bool) else str(v)


def compare(spark, folder, name, f, sql):
    """None if both give the same rows, or two runs where there is no twin; else what differs."""
    df = f(spark, folder)
    cols = sorted(df.columns)
    mine = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        again = sorted(tuple(cell(r[c]) for c in cols) for r in f(spark, folder).collect())
        return None if mine == again else "two runs differ"
    rel = connect(folder).sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    if mine != theirs:
        odd = [x for x in mine if x not in set(theirs)][:3], [x for x in theirs if x not in set(mine)][:3]
        return f"{len(mine)} and {len(theirs)} rows; {odd}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from strataloom.session import build_session

    args = sys.argv[1:]
    folder = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("--") and a != folder]
    spark = build_session()
    spark.sparkContext.setLogLevel("OFF")
    q, o = e.queries(), e.oracle_sql()
    for n in names or q:
        if not names and n not in o and n.startswith("p"):
            continue
        t = time.time()
        try:
            bad = compare(spark, folder, n, q[n], o.get(n))
        except Exception as error:
            bad = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{n}: {'same' if not bad else 'DIFFERS ' + bad}{'' if n in o else ' (no twin)'} {time.time() - t:.1f}s", flush=True)
    os._exit(0)
