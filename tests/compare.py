"""Runs queries and their SQL side by side and compares rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

#: The smallest given tables, which the tests run over.
SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return repr(v) if v is None or isinstance(v, bool) else (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = build(spark, sf_dir)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if have[0] != want[0]:
        return f"columns {have[0]} != {want[0]}"
    if have[1] == want[1]:
        return None
    extra = [r for r in have[1] if r not in set(want[1])][:2]
    lack = [r for r in want[1] if r not in set(have[1])][:2]
    return f"rows {len(have[1])} != {len(want[1])}\n  spark only {extra}\n  sql only {lack}"


def main(names, sf_dir: str) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, queries, oracle = connect(sf_dir), 0, entry.queries(), entry.oracle_sql()
    for name, build in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in oracle:
                diff = compare(spark, con, build, oracle[name], sf_dir)
                n = ""
            else:
                diff, n = None, f" rows={build(spark, sf_dir).count()}"
        except Exception as e:
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += diff is not None
        kind = "sql" if name in oracle else "rows"
        print(f"{'ok ' if diff is None else 'BAD'} {name} [{kind}] {time.time() - t:.1f}s{n}"
              + ("" if diff is None else f"\n  {diff[:1500]}"), flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(bool(main(args, where)))
