"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from examlake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.fixture(scope="module")
def views():
    link = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        link.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return link


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, views, name):
    got = catalog.QUERIES[name](spark, DATA)
    expected = views.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(got.columns)
    types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}
    assert {c: types[k] for c, k in got.dtypes} == {d[0]: str(d[1]) for d in expected.description}
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
