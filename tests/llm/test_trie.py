"""Crowded trie nodes: no link is lost, and copies don't grow with the rows of a node."""

import random

import pytest

from quillstone.llm import simhash
from tests.llm.test_operators import brute_components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def crowded(n, seed=1):
    """Fingerprints of one quarter, some of them within three bits of others."""
    r = random.Random(seed)
    found = []
    while len(found) < n:
        fp = (0xABCD << 48) | r.getrandbits(48)
        for _ in range(r.choice((1, 1, 2, 4))):
            found.append(fp)
            for bit in r.sample(range(64), r.randint(1, 4)):
                fp ^= 1 << bit
    return sorted(set(found))[:n]


@pytest.mark.parametrize("node_rows", [2, 7, 40, 5000])
def test_links_of_a_crowded_node_by_brute_force(spark, node_rows):
    fps = crowded(400)
    edges = simhash.forests(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), node_rows=node_rows).collect()
    root = list(range(len(fps)))
    at = {signed(f): i for i, f in enumerate(fps)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(at[u]), find(at[v])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == brute_components(fps)


def test_copies_of_a_fingerprint_do_not_grow_with_its_node(spark):
    for n in (1000, 4000):
        r = random.Random(n)
        fps = {(0xABCD << 48) | r.getrandbits(48) for _ in range(n)}
        dealt = simhash.deal(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), node_rows=n // 20)
        most = dealt.where("by = 0").groupBy("fp").count().agg({"count": "max"}).first()[0]
        assert most <= 9
        assert dealt.groupBy("by", "depth", "a", "b").count().agg({"count": "max"}).first()[0] <= n // 20


def test_a_large_component_has_no_hot_key(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB_ROWS", 8)
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 60)] + [(r.randrange(100, 140), r.randrange(140, 200)) for _ in range(70)] + [(200, 201), (201, 202)]
    got = dict(map(tuple, simhash.stars(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
