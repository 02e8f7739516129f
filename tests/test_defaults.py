"""Registered queries run their operators with the operators' defaults."""

import os

import pytest

from quillstone.operators import doublets, trends
from quillstone.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_all_shuffles_are_dealt(spark):
    assert {r["shuffle"] for r in catalog.QUERIES["shuffled_walks"](spark, DATA).select("shuffle").distinct().collect()} == set(range(1, 21))


def test_operators_get_no_smaller_settings(spark, monkeypatch):
    given = {}
    for module, name in ((trends, "curves"), (doublets, "co_expression"), (doublets, "neighbourhoods")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: given.update({_n: (len(a), k)}) or _f(*a, **k))
    for name in ("trend_curves", "doublet_co_expression", "doublet_neighbourhoods"):
        catalog.QUERIES[name](spark, DATA)
    assert given == {"curves": (1, {}), "co_expression": (2, {}), "neighbourhoods": (1, {})}
