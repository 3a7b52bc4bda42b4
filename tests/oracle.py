"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _sort_key(row):
    return tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when both agree, else what differs."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    left = [tuple(r[n] for n in names) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    t2 = time.time()
    compare.times = (t1 - t0, t2 - t1)
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    expected = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    for n in names:
        if expected.get(types[n], types[n]) != kinds[n]:
            return f"type of {n}: {types[n]} vs {kinds[n]}"
    at = [cols.index(n) for n in names]
    right = [tuple(r[i] for i in at) for r in rows]
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    if not left:
        return "no rows"
    left.sort(key=_sort_key)
    right.sort(key=_sort_key)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference over {names}: {a} vs {b}"
    for row in left:
        for x in row:
            if isinstance(x, float) and (math.isnan(x) or (x == 0 and math.copysign(1, x) < 0)):
                return f"NaN or -0.0 in {row}"
    return None


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from gridspark.session import local_session

    sf_dir = argv[0]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, queries[name], oracles[name])
                times = "spark %.1fs duck %.1fs" % compare.times
            else:
                t0 = time.time()
                rows = queries[name](spark, sf_dir).collect()
                problem, times = (None if rows else "no rows"), f"rows only, {len(rows)} rows, {time.time() - t0:.1f}s"
        except Exception as e:  # report and go on with the next query
            problem, times = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += problem is not None
        print(("ok  " if problem is None else "FAIL"), name, times, problem or "", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
