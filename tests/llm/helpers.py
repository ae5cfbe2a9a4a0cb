"""Comparing a query with its SQL, as DuckDB runs it over the same tables."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def sql_rows(sql, sf="sf0.001", views=None):
    c = duckdb.connect()
    for p in sorted((DATA / sf).glob("*.parquet")):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, frame in (views or {}).items():
        c.register(f"{name}_", frame)
        c.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_")
    found = c.sql(sql)
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def same(df, rows):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted((r.asDict() for r in df.collect()), key=key) == sorted(rows, key=key)
