"""Run registered queries and their SQL side by side.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LAST = {"spark": 0.0, "sql": 0.0}


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return repr(round(v, 9))
        return "NULL" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    start = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    LAST["spark"] = time.time() - start
    got = canonical(rows, df.columns)
    if sql is None:
        return None if got else "no rows"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = canonical(cur.fetchall(), names)
    LAST["sql"] = time.time() - start
    if got == want:
        return None
    a, b = set(got), set(want)
    return f"rows {len(got)} != {len(want)}; only spark {len(a - b)}: {sorted(a - b)[:2]}; only sql {len(b - a)}: {sorted(b - a)[:2]}"


def main(argv):
    import __spark_entry__ as entry
    from matchloom.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in argv or queries:
        try:
            problem = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} spark {LAST['spark']:.1f}s sql {LAST['sql']:.1f}s {'' if problem is None else problem}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} of {len(argv or queries)} differ: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
