"""The pipeline: planted cases, kept columns, odd rows."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as C

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string"
KEY = "9f1a7029c8514dfe98aba92898d323168e199da0"


def prose(rng, n):
    words = [rng.choice("the of and in to a".split()) if rng.random() < 0.35 else "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(4, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    docs = {i: prose(rng, rng.randint(60, 300)) for i in range(150)}
    item = prose(rng, 40)
    words = docs[1].split()
    words[20] = "altered"
    docs |= {200: docs[0], 201: " ".join(words), 202: prose(rng, 60) + " " + " ".join(item.split()[5:30]) + " " + prose(rng, 60)}
    docs[203] = prose(rng, 80) + f' token = "{KEY}" ' + prose(rng, 80)
    docs |= {i: " ".join(w.upper() + "!!" for w in prose(rng, 90).split()) for i in range(300, 315)}
    docs |= {i: " ".join(w + "###" for w in prose(rng, 90).split()) for i in range(315, 330)}
    docs |= {i: " ".join([prose(rng, 1)] * 120) for i in range(330, 345)}
    docs |= {400: None, 401: "", 402: prose(rng, 40000)}
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k") for i, t in docs.items()] + [(5, docs[5], "en", "s", len(docs[5]), 0.5, "k"), (None, prose(rng, 100), None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
    return folder, docs


def test_planted_cases(spark, planted):
    folder, docs = planted
    rows = C.run(spark, str(folder)).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and None in ids
    gone = {200, 201, 202, 400, 401} | set(range(300, 345))
    assert set(ids) - {None} == set(docs) - gone
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["decoded"] == docs[i] and by_id[i]["n_tokens"] * 4 == len(by_id[i]["ids"]) for i in set(ids) - {None, 203})
    assert KEY not in by_id[203]["decoded"] and "[SECRET]" in by_id[203]["decoded"]


def test_stages_keep_the_columns_and_take_empty_tables(spark, planted):
    folder, _ = planted
    none = spark.read.parquet(str(folder / "documents.parquet")).where("false")
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, none, str(folder))
        assert out.count() == 0
        if i < len(C.STAGES) - 1:
            assert out.columns == none.columns
