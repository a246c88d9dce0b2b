"""Collapse of cumulative logs and rendering."""

from __future__ import annotations

import random

import duckdb

from tallyforge.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string"


def log(spark, conversations):
    return spark.createDataFrame([(c, t, role, text, "x") for c, turns in conversations for t, (role, text) in enumerate(turns)], SCHEMA)


def rendered(df, **named):
    parts = {}
    for r in chat.render(df, **named).collect():
        parts.setdefault(r["conv_id"], []).append((r["part"], r["text"], r["n_turns"], r["n_logged"]))
    return {c: ("".join(t for _, t, _, _ in sorted(p)), p[0][2], p[0][3]) for c, p in parts.items()}


def text_of(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    conversations = [(c, [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(1, 5))]) for c in range(120)]
    want = {}
    for c, turns in conversations:
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for _, o in conversations)
        same = [d for d, o in conversations if o == turns]
        if not longer and c == min(same):
            want[c] = (text_of(turns), len(turns), len(same))
    assert rendered(log(spark, conversations)) == want
    assert rendered(log(spark, conversations), turns_per_part=2) == want


def test_null_and_empty_differ_and_repeated_rows_are_one(spark):
    df = log(spark, [(1, [("user", None)]), (2, [("user", ""), ("assistant", "x")]), (3, [(None, "y")])])
    assert set(rendered(df.union(df))) == {1, 2, 3}


def test_rows_without_an_id_are_conversations_of_one_turn(spark):
    rows = [(None, 0, "user", "a", ""), (None, None, "user", "z", ""), (None, 3, "user", "z", ""), (None, 3, "user", "z", "again"), (7, 0, "user", "z", ""), (8, 5, "user", "q", ""), (8, 6, "user", "r", ""), (None, 9, "user", "q", "")]
    got = sorted(((r["conv_id"], r["n_turns"], r["n_logged"], r["text"]) for r in chat.render(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 1, 1, text_of([("user", "a")])), (7, 1, 3, text_of([("user", "z")])), (8, 2, 1, text_of([("user", "q"), ("user", "r")]))], key=str)


def test_turns_without_a_number_come_first_in_parts_by_digest(spark):
    df = spark.createDataFrame([(1, None, "user", f"t{i}", "") for i in range(300)] + [(1, 0, "user", "last", "")], SCHEMA)
    (text, n, logged), = rendered(df).values()
    said = text.split("<|im_end|>\n")[:-1]
    assert (n, logged, said[-1]) == (301, 1, "<|im_start|>user\nlast") and len(set(said)) == 301 and chat.render(df).count() > 100


def test_registered_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2, 600]), rng.choice(["user", None]), rng.choice(["a", "", None]), "x") for _ in range(150)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = duck.execute(chat.OP10_SQL)
    columns = [c[0] for c in theirs.description]
    ours = chat.op10_chat(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in ours) == sorted(map(str, theirs.fetchall()))


def test_long_conversations_and_empty_tables(spark):
    turns = [("user", str(i)) for i in range(1500)]
    df = log(spark, [(1, turns), (2, turns[:700])])
    assert rendered(df) == {1: (text_of(turns), 1500, 1)} and chat.render(df).count() == 3
    assert chat.render(df.where("false")).count() == 0
