"""Every core query runs on the smallest tables and equals its SQL there."""

from pathlib import Path

import pytest

from marginalia.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings doc_pages blocks refs chunks evidence used_refs mix_targets".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")


def value(x):
    if isinstance(x, float):
        return repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(value, x)) + "]"
    return repr(x)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(value(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(got, df.columns) == rows(want.fetchall(), list(want.columns))
