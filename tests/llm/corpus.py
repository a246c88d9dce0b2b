"""Small corpora that the tests of the registered queries read."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n long"


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice("the of and in to a".split()) if rng.random() < 0.35 else "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(4, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


def texts(seed: int = 5) -> dict:
    """Texts by id: prose, exact and near copies, null, empty, wordless, very long, odd characters."""
    rng = random.Random(seed)
    found = {i: prose(rng, rng.randint(1, 120)) for i in range(1, 61)}
    found |= {i: found[1] for i in range(100, 130)}
    for i in range(130, 140):
        words = found[i - 128].split()
        words[rng.randrange(len(words))] = "Altered"
        found[i] = " ".join(words)
    return found | {200: None, 201: "", 202: " \n\t ", 203: prose(rng, 20_000), 204: "É xİ ß 你好 🙂 \x1c end", 205: "a", 206: None, 300: "x" * 3000}


def written(spark, folder, docs: dict, **tables) -> str:
    """``documents`` with clashing further columns, and other tables as (rows, schema), in a folder."""
    rows = [(i, t, "en", "s", len(t or ""), "clash", 7) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
