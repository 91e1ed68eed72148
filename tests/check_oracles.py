"""Run registered queries beside their SQL statements and compare the rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value: object) -> str:
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    mine = sorted(tuple(normal(row[c]) for c in order) for row in df.collect())
    place = [names.index(c) for c in order]
    theirs = sorted(tuple(normal(row[i]) for i in place) for row in expected)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows; {[r for r in mine if r not in theirs][:2]} | {[r for r in theirs if r not in mine][:2]}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{order}: {a} != {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from sparkmeter.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session(
        "check", "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
         "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                size = "" if problem else f"{df.count()} rows"
            else:
                problem, size = None, f"{df.count()} rows, no SQL"
        except Exception as error:
            problem, size = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or size}", flush=True)
    print(f"{bad} failures")
    sys.exit(bool(bad))
