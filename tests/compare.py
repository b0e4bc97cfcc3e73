"""Run registered queries against their SQL on the same parquet files."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(repr(r[i]) for i in order) for r in rows])


def differences(spark, con, query, sql, sf_dir):
    """Empty text if the results are equal, else what differs first."""
    df = query(spark, sf_dir)
    cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = canonical(names, cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; only Spark {extra}; only SQL {lost}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"spark {a} != sql {b}", len(got)
    return "", len(got)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from sqlgauge.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                diff, n = differences(spark, con, fn, sqls[name], sf_dir)
            else:
                diff, n = "", len(fn(spark, sf_dir).collect())
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        mark = "ok " if not diff else "BAD"
        print(f"{mark} {name} rows={n} {time.time() - t:.1f}s {'' if name in sqls else '(no sql)'} {diff}", flush=True)
