"""Side-by-side runner: a registered query against its SQL on DuckDB."""

import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    if len(a) != len(b):
        return f"rows differ: {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return None
    near = sum(all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 1e-5)
                   for p, q in zip(x, y)) for x, y in bad)
    return f"{len(bad)} of {len(a)} rows differ ({near} only by rounding), e.g.\n   {bad[0][0]}\n   {bad[0][1]}"


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf = sys.argv[1]
    pats = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", "/tmp").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    n_ok = n_bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, sf, fn, sqls[name])
            else:
                n = fn(spark, sf).count()
                msg = None if n else "no rows"
        except Exception as ex:  # noqa: BLE001
            msg = f"{type(ex).__name__}: {str(ex)[:1500]}"
        n_ok, n_bad = n_ok + (msg is None), n_bad + (msg is not None)
        print(f"{'ok ' if msg is None else 'BAD'} {name:34s} {time.time() - t:6.1f}s {'' if name in sqls else '(rows only)'} {msg or ''}", flush=True)
    print(f"{n_ok} ok, {n_bad} bad")


if __name__ == "__main__":
    main()
