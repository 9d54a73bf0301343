"""Compares a query with its SQL on DuckDB."""

import duckdb

from factlake.plans.registry import BASE


def connect(sf_dir):
    duck = duckdb.connect()
    for name in BASE:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return duck


def same_rows(df, sql, sf_dir):
    want = connect(sf_dir).execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    own = sorted((tuple(r[n] for n in sorted(names)) for r in df.collect()), key=repr)
    other = sorted((tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall()), key=repr)
    assert len(own) == len(other)
    assert own == other
    return len(own)
