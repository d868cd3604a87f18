"""Every query of the library against its SQL on the smallest tables, and the registry's shape."""

import glob
import math
import os

import duckdb
import pytest

from ripplemark import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "~" if v is None else v.isoformat()[:26] if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_and_optional_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    order = [df.columns.index(c) for c in got.columns]
    ours = sorted(tuple(norm(r[i]) for i in order) for r in df.collect())
    assert ours == sorted(tuple(norm(x) for x in r) for r in got.fetchall())
