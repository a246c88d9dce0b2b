"""Benchmark windows against brute force."""

from __future__ import annotations

import random

import pytest

from tallyforge.llm import decontaminate as D


def brute(text, items, window):
    words, hit, found = D.words(text), set(), set()
    for item, body in items:
        own = D.words(body)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1) if size else ():
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(words), hit, sorted(found)


def sample(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(12)] + ["Ünï", "ABC"]
    make = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 4, 9, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, "--"), (None, make(15))]
    docs = [(i, make(rng.choice([0, 3, 40, 200]))) for i in range(30)] + [(90, None), (91, "")]
    for i in range(10):
        body = rng.choice(items[:12])[1].upper().replace(" ", ", ")
        docs.append((100 + i, f"{make(5)} - {body} {make(4)}"))
    return docs + docs[-2:], items


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (1, 0), (2, 150), (4, 0)])
def test_equals_brute_force(spark, seed, block):
    docs, items = sample(seed)
    found = D.find_benchmark(
        spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, spans int"), spark.createDataFrame(items, "item_id bigint, text string"), window=6, block_bytes=block
    ).collect()
    got = sorted((r["id"], r["n_words"], sorted(p for s in r["spans"] for p in range(s["start"], s["end"])), list(r["items"])) for r in found)
    want = []
    for i, t in docs:
        n, hit, names = brute(t, items, 6)
        want.append((i, n, sorted(hit), names))
    assert got == sorted(want)


def test_removal_keeps_clean_rows(spark):
    docs, items = sample(3)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = D.decontaminate(frame, spark.createDataFrame(items, "item_id bigint, text string"), window=6)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in docs if not brute(t, items, 6)[1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r["n_words"], list(r["spans"])) for r in D.find_benchmark(docs, none).collect()] == [(2, [])]
    assert D.find_benchmark(docs.where("false"), none).count() == 0
