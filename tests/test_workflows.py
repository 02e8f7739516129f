"""The further queries on the smallest tables, against their SQL where there is one."""

import os

import duckdb
import pytest

from quillstone.plans import catalog, workflows
from tests.test_catalog import DATA, TABLES, normal

NAMES = sorted(n for n in catalog.QUERIES if getattr(workflows, n, None) is not None and getattr(workflows, n).__module__ == workflows.__name__)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name not in catalog.SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)
