"""Quality classifier: label model, scorer, filter."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from tallyforge.llm import quality as Q

WORDS = "the of and to in a is that house river window garden letter morning paper stone water mountain yellow quiet".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        k = min(rng.randint(5, 14), n - len(out))
        out += [rng.choice(WORDS) + rng.choice(["", "", "s", "er"]) for _ in range(k)]
        out[-1] += "."
    return " ".join(out)


def junk(rng, n):
    words = prose(rng, n).split()
    kind = rng.randrange(4)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "$$$", "%%%", "***"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " ".join([rng.choice(words)] * n)
    return " | ".join(w for w in words if len(w) > 4)


def corpus(seed, n=600):
    rng = random.Random(seed)
    return [(i, junk(rng, rng.randint(40, 200)) if i % 6 == 0 else prose(rng, rng.randint(8, 300)), int(i % 6 != 0)) for i in range(n)]


def test_finds_junk_without_labels(spark):
    train, held = corpus(1), corpus(2)
    model = Q.fit(spark.createDataFrame(train, "doc_id bigint, text string, quality int"))
    rows = Q.score(spark.createDataFrame(held, "doc_id bigint, text string, score int"), model).collect()
    truth = {i: q for i, _, q in held}
    good = [r["score"] >= Q.THRESHOLD for r in rows if truth[r["id"]]]
    bad = [r["score"] < Q.THRESHOLD for r in rows if not truth[r["id"]]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) >= 0.9 * len(bad)


def test_label_model_weighs_labellers_by_their_accuracy():
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.8
    digits = np.full((6000, len(Q.LABELLERS)), Q.NONE)
    for i, accuracy in enumerate([0.95, 0.9, 0.85, 0.6]):
        votes = np.where(rng.random(6000) < accuracy, truth, ~truth).astype(int)
        digits[:, i] = np.where(rng.random(6000) < 0.9, votes, Q.NONE)
    patterns, counts = np.unique(digits @ 3 ** np.arange(len(Q.LABELLERS)), return_counts=True)
    model = Q.fit_labels(patterns, counts.astype(float))
    right = [model.chances[1, i, Q.GOOD] for i in range(4)]
    assert right[0] > right[1] > right[2] > right[3] and abs(right[0] - 0.95) < 0.03 and abs(model.prior - 0.8) < 0.03


def naive_em(patterns, counts, rounds):
    """The same model, text by text: (share of good texts, chances by class, labeller and vote)."""
    rows = [([p // 3**i % 3 for i in range(len(Q.LABELLERS))], n) for p, n in zip(patterns, counts)]
    good = []
    for votes, _ in rows:
        voted = [v for v in votes if v != Q.NONE]
        g = (sum(v == Q.GOOD for v in voted) + 0.5) / (len(voted) + 1)
        good.append(min(g, 0.2) if sum(v == Q.BAD for v in voted) >= 2 else g)
    for _ in range(rounds):
        prior = (sum(g * n for g, (_, n) in zip(good, rows)) + 1) / (sum(counts) + 2)
        chance = {}
        for c in (0, 1):
            for i in range(len(Q.LABELLERS)):
                held = [sum((g if c else 1 - g) * n for g, (votes, n) in zip(good, rows) if votes[i] == v) + 1 for v in (Q.BAD, Q.GOOD)]
                chance[c, i] = [h / sum(held) for h in held]
        odds = []
        for votes, _ in rows:
            like = [1 - prior, prior]
            for c in (0, 1):
                for i, v in enumerate(votes):
                    like[c] *= 1 if v == Q.NONE else chance[c, i][v]
            odds.append(like[1] / sum(like))
        good = odds
    return prior, chance, good


def test_label_model_equals_naive_expectation_maximisation():
    rng = random.Random(2)
    patterns = rng.sample(range(3 ** len(Q.LABELLERS)), 60)
    counts = [rng.randint(1, 50) for _ in patterns]
    model = Q.fit_labels(np.array(patterns), np.array(counts, float), rounds=15)
    prior, chance, good = naive_em(patterns, counts, 15)
    assert abs(model.prior - prior) < 1e-9
    assert all(abs(model.chances[c, i, v] - chance[c, i][v]) < 1e-9 for c in (0, 1) for i in range(len(Q.LABELLERS)) for v in (Q.BAD, Q.GOOD))
    assert np.abs(model.posterior(np.array(patterns)) - good).max() < 1e-9


def test_scorer_equals_naive_descent():
    rng = np.random.default_rng(4)
    features, sure, target = rng.random((12, Q.DIMENSIONS + 3)), rng.random(12), rng.random(12)
    scorer = Q.fit_scorer(features, sure, target, rounds=3)
    mean, spread = features.mean(axis=0), features.std(axis=0)
    spread[Q.DIMENSIONS :] = 1 / Q.TERM_WEIGHT
    rows = [[max(-8, min(8, (v - m) / d)) * s for v, m, d in zip(f, mean, spread)] for f, s in zip(features, sure)]
    step = 0.5 / max(1, sum(v * v for r in rows for v in r) / 12 / 4)
    weights, bias = [0.0] * len(mean), 0.0
    for _ in range(3):
        error = [1 / (1 + np.exp(-(sum(w * v for w, v in zip(weights, r)) + bias))) - t for r, t in zip(rows, target)]
        weights = [w - step * (sum(e * r[j] for e, r in zip(error, rows)) / 12 + 1e-3 * w) for j, w in enumerate(weights)]
        bias -= step * sum(error) / 12
    assert np.abs(scorer.weights - weights).max() < 1e-9 and abs(scorer.bias - bias) < 1e-9
    assert abs(scorer.score(features[:1], sure[:1])[0] - 1 / (1 + np.exp(-(sum(w * v for w, v in zip(weights, rows[0])) + bias)))) < 1e-9


def test_terms_are_hashed_words_and_pairs():
    t = Q.terms(Q.Text.of("Aa bb aa bb"))
    slots = {k: zlib.crc32(k.encode()) % Q.TERM_DIMENSIONS for k in ("aa", "bb")}
    pair = lambda a, b: zlib.crc32(b.encode(), zlib.crc32(a.encode())) % Q.TERM_DIMENSIONS
    assert set(np.flatnonzero(t)) == {*slots.values(), pair("aa", "bb"), pair("bb", "aa")} and abs((t**2).sum() - 1) < 1e-9
    assert not Q.terms(Q.Text.of(" ")).any()


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_registered_query_agrees_with_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = Q.op6_quality(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows.columns == ["doc_id", "weak_posterior", "score", "keep"] and rows.count() == docs.count()
    known = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in known) >= 0.99 * len(known)


def test_filter_keeps_columns_and_rejects_the_wordless(spark):
    rows = corpus(3, 120) + [(900, None, 1), (901, "", 1), (902, "  \n", 1), (903, prose(random.Random(9), 30000), 1)]
    docs = spark.createDataFrame([(i, t, q, 1.5) for i, t, q in rows], "doc_id bigint, text string, quality int, score double")
    kept = Q.keep_good(docs, Q.fit(docs))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.schema == docs.schema and not ids & {900, 901, 902} and 903 in ids
    assert all(i in ids for i, _, q in rows if q and i < 900)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert Q.fit(none) is None and Q.score(none, None).count() == 0 and Q.keep_good(none, None).count() == 0
