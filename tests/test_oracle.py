"""Every query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(v):
    if v is None or str(v) in ("NaT", "<NA>") or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v


def rows(df):
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert len(set(cols)) == len(cols)
    assert name in catalog.oracle_sql()
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    assert rows(got.select(*[f"`{c}`" for c in cols]).toPandas()) == rows(want[cols])
