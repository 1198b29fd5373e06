"""Components against a plain search, with hubs, chains and cycles."""

import random

import pytest

from tidegauge.llm import components as C
from tidegauge.llm.common import Stored


@pytest.mark.parametrize("share", [2, 500])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(C, "SHARE", share)
    rnd = random.Random(3)
    edges = [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(0, 60)] + [(500, 501), (501, 502), (502, 500), (7, 7), (501, 500), (5000, 1)]
    edges += [(rnd.randint(2000, 2300), rnd.randint(2000, 2300)) for _ in range(200)] + [(1300 + k, 1299 + k) for k in range(10)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.node: r.root for r in C.components(df, Stored(df, "test")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(up)}
    none = spark.createDataFrame([], "a long, b long")
    assert C.components(none, Stored(none, "test")).count() == 0
