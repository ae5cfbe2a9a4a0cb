"""Every query with SQL against DuckDB over the same tables."""

from pathlib import Path

import duckdb
import pytest

from spandrel.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    expected = c.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(expected.columns)
    order = [expected.columns.index(k) for k in sorted(expected.columns)]
    want = sorted(tuple(value(r[i]) for i in order) for r in expected.fetchall())
    have = sorted(tuple(value(r[k]) for k in sorted(got.columns)) for r in got.collect())
    assert have == want
    assert have
