"""Every registered core query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tabloom import catalog, catalog_api  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, SF)
    want = tables.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [list(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_sample_has_so_many_rows(spark):
    assert catalog.QUERIES["sample_n"](spark, SF).count() == 100
