"""Every core query on the smallest tables, against its SQL where there is one."""

import os

import duckdb
import pandas as pd
import pytest

from quillstone.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def normal(df: pd.DataFrame) -> list:
    return sorted((tuple(None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
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
