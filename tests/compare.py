"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math

import duckdb

from factlake.plans.registry import BASE, full_sql

SAME = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "int"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def ordered(columns: list[str], rows) -> list[str]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in at]) for r in rows)


def compare(query, df, con) -> tuple[int, list[str]]:
    """Row count and the differences found, empty where all agrees."""
    got = ordered(df.columns, df.collect())
    if query.sql is None:
        return len(got), []
    cur = con.execute(full_sql(query.sql))
    names = [d[0] for d in cur.description]
    want = ordered(names, cur.fetchall())
    faults = []
    if sorted(names) != sorted(df.columns):
        faults.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    kinds = dict(zip(names, [str(d[1]).lower() for d in cur.description]))
    for name, kind in df.dtypes:
        other = kinds.get(name, "")
        if other in ("hugeint",) or ("decimal" in other) != ("decimal" in kind):
            faults.append(f"type of {name}: {kind} / {other}")
        if kind in ("int", "bigint") and other not in ("integer", "bigint"):
            faults.append(f"type of {name}: {kind} / {other}")
    if len(got) != len(want):
        faults.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        only = [g for g in got if g not in set(want)][:2] + [w for w in want if w not in set(got)][:2]
        faults += [f"differs: {o[:600]}" for o in only]
    return len(got), faults


def main(argv: list[str]) -> None:
    import time

    from factlake.plans import catalog  # noqa: F401
    from factlake.plans.registry import QUERIES, Tables
    from factlake.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, q in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            n, faults = compare(q, q.run(Tables(spark, sf_dir)), con)
        except Exception as e:  # noqa: BLE001
            n, faults = -1, [f"{type(e).__name__}: {str(e)[:900]}"]
        bad += bool(faults)
        print(f"{'FAIL' if faults else 'ok'} {name} rows={n} {time.time() - began:.1f}s", *faults, sep="\n    " if faults else " ")
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
