"""Run the registered queries next to their SQL and compare: ``python -m checks.compare [dir] [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir, f"{table}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{round(value, 6):.6f}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{value:.6f}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - started
    if sql is None:
        return True, f"{len(mine)} rows, no oracle, {spark_s:.1f}s"
    started = time.time()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    note = f"{len(mine)} rows, spark {spark_s:.1f}s, duckdb {time.time() - started:.1f}s"
    types = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    want = {n: types[t] for n, t in df.dtypes}
    have = {c[0]: str(c[1]) for c in result.description}
    odd = {n: (want.get(n), have[n]) for n in have if want.get(n) != have[n]}
    if odd:
        note += f", types {odd}"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}; {note}"
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(mine)][:3]
        return False, f"{len(mine)} vs {len(theirs)} rows\n   spark:  {only_mine}\n   duckdb: {only_theirs}\n   {note}"
    return True, note


def main() -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from sigweave.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in chosen:
        try:
            ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
