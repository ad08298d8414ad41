"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = sql.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left, right = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(left) == len(right)
    for c in columns:
        assert ((left[c] == right[c]) | (left[c].isna() & right[c].isna())).all(), c
