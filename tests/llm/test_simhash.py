"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import simhash as S
from tests.llm import corpus as small
from tallyforge.llm.components import components


def brute(prints, radius):
    """The smallest id that each id reaches over fingerprints within the radius."""
    ids = sorted(prints, key=lambda i: (i is None, i))
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_every_pair_within_the_radius_meets(radius):
    rng = random.Random(radius)
    masks = S.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(500):
        differ = sum(1 << p for p in rng.sample(range(64), radius))
        assert any(not differ & m for m in masks)
    sub = masks[0]
    for _ in range(200):
        places = [p for p in range(64) if sub >> p & 1]
        differ = sum(1 << p for p in rng.sample(places, radius))
        assert any(not differ & m for m in S.masks(radius, sub))


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    words = S.words("A b\tc  D")
    assert words == [b"a", b"b", b"c", b"d"] and S.words(None) == [] and S.words("\x1c") == [b"\x1c"]
    runs = S.shingles(words, 3)
    assert runs == [b"a b c", b"b c d"] and S.shingles(words[:2], 3) == [b"a b"] and S.shingles([], 3) == []
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    assert S.fingerprint(runs) == hashes[0] & hashes[1] and S.fingerprint([]) == 0


def corpus(rng):
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 30, 200]))) for _ in range(25)]
    texts = [None, "", " \n ", *base, *base[:5]]
    for text in base[:15]:
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus(random.Random(1))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, fingerprint string")
    prints = {i: S.fingerprint(S.shingles(S.words(t), 3)) for i, t in enumerate(texts)}
    expected = brute(prints, 3)
    for limit in (S.BUCKET_LIMIT, 2):
        rows = S.near_duplicates(docs, bucket_limit=limit).collect()
        assert {r["id"]: (int(r["fingerprint"], 16), r["component"]) for r in rows} == {i: (prints[i], expected[i]) for i in prints}


def test_hot_bucket_links_are_fewer_than_its_nodes(spark):
    rng = np.random.default_rng(0)
    centre = 0x0123456789ABCDEF
    values = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (600, 2))}
    frame = spark.createDataFrame([(S.signed(v),) for v in values], "print bigint")
    for limit in (S.BUCKET_LIMIT, 50):
        edges = S.links(frame, 3, bucket_limit=limit)
        found = components(edges)
        assert found.count() == len(values) and found.select("component").distinct().count() == 1
    assert S.links(frame, 3).count() < len(S.masks(3)) * len(values)


def test_ties_nulls_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q w e r t"), (2, None)], schema)
    rows = sorted(((r["id"], r["component"]) for r in S.near_duplicates(twice).collect()), key=str)
    assert rows == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2)], key=str)
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_registered_query(spark, tmp_path):
    docs = small.texts()
    rows = S.op1_simhash(spark, small.written(spark, tmp_path, docs)).collect()
    prints = {i: S.fingerprint(S.shingles(S.words(t), 3)) for i, t in docs.items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", c) for i, c in brute(prints, 3).items()}
    assert len(rows) == len(docs) and prints[200] == prints[201] == prints[202] == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [tuple(r) for r in components(edges).groupBy("component").count().collect()] == [(0, 201)]
