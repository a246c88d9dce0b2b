"""Connected components in fewer stages, against union-find."""

from __future__ import annotations

import random

import pytest

from tallyforge.llm.components import contracted


@pytest.mark.parametrize("at_once", [1 << 20, 3])
def test_contracted_against_union_find(spark, at_once):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(-40, 40)] + [(1000, i) for i in range(900, 1100)]  # a chain through zero and a star
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(140)] + [(7, 7), (5000, 5000), (1, 2)]
    rng.shuffle(edges)
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    found = {r["node"]: r["component"] for r in contracted(frame, at_once).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: root(n) for n in linked}
    assert contracted(frame.where("false"), at_once).count() == 0
