"""Run queries against their DuckDB oracles: python tests/oracle_check.py [sf_dir] [name ...]."""

import importlib.util
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def load_entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    if value.__class__.__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    t = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}", took, sql_took
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}; first extra {next(iter(set(map(repr, a)) ^ set(map(repr, b))), None)}", took, sql_took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)}/{len(a)} rows differ, e.g. {bad[0]}", took, sql_took
    return True, f"{len(a)} rows", took, sql_took


if __name__ == "__main__":
    from tidewheel.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    entry = load_entry()
    from tidewheel.session import release

    spark = build_session("oracle", "8")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        try:
            if name in oracles:
                ok, note, took, sql_took = compare(spark, con, queries[name], oracles[name], sf)
            else:
                t = time.time()
                n = len(queries[name](spark, sf).collect())
                ok, note, took, sql_took = True, f"{n} rows (no oracle)", time.time() - t, 0.0
        except Exception as e:
            ok, note, took, sql_took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0, 0.0
        release()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {took:6.2f}s sql {sql_took:5.2f}s {note}", flush=True)
    print("failed:", failed)
