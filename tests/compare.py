"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, sorted(tuple(_cell(v) for v in r) for r in rows)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = cursor.fetchall()
    return [names[i] for i in order], sorted(tuple(_cell(_plain(r[i])) for i in order) for r in rows)


def _plain(value):
    from decimal import Decimal

    return float(value) if isinstance(value, Decimal) else value


def difference(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    names, rows = spark_rows(df)
    other_names, other = sql_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(rows) != len(other):
        return f"{len(rows)} rows != {len(other)}"
    bad = [(a, b) for a, b in zip(rows, other) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"[:600]
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from pairframe.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                result = difference(df, con, sqls[name])
            else:
                result = None if df.count() >= 0 else "no rows"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:700]}"
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
