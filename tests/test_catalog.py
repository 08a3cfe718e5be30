"""Each catalogue query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from groundloom import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 5) + 0.0


def rows(names, found):
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DATA)
    names = sorted(found.columns)
    got = rows(names, [r.asDict() for r in found.collect()])
    if name in ORACLES:
        db = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = db.sql(ORACLES[name])
        columns = list(want.columns)
        assert sorted(columns) == names
        assert got == rows(names, [dict(zip(columns, r)) for r in want.fetchall()])


def test_entry(spark):
    assert catalog.flagship(spark, DATA).count() > 0
