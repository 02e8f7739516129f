"""The registered permutation test reads all cells."""

import os

import pytest

from quillstone.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_means_are_of_all_cells(spark):
    got = {(r.label, r.gene): (r.mean, r.p) for r in catalog.QUERIES["marker_permutation"](spark, DATA).collect()}
    orders, lines = (spark.read.parquet(f"{DATA}/{t}.parquet").toPandas() for t in ("orders", "lineitem"))
    cells = orders.groupby("o_orderpriority").size()
    sums = lines.assign(gene=lines.l_partkey % 40).merge(orders, left_on="l_orderkey", right_on="o_orderkey").groupby(["o_orderpriority", "gene"]).l_quantity.sum()
    assert {k: v[0] for k, v in got.items() if v[0]} == pytest.approx({(label, gene): x / cells[label] for (label, gene), x in sums.items()}, abs=1e-6)
    assert all(abs(p * 101 - round(p * 101)) < 1e-3 for _, p in got.values())  # of 100 shuffles
