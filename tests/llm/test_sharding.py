"""Interleaved shards: law, mixture, slots."""

from __future__ import annotations

from collections import Counter

from tallyforge.llm import sharding


def place(spark, rows, **named):
    return sharding.interleave(spark.createDataFrame(rows, "doc_id bigint, source string, shard string"), **named).collect()


def test_counts_mixture_and_slots(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "x") for i in range(1003)]
    placed = place(spark, rows)
    counts = Counter(r["shard"] for r in placed)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(n))
    source = {i: s for i, s, _ in rows}
    # A cut is exact in rows, so against a source's share it is off by a row of each source at most.
    for name, total in Counter(source.values()).items():
        per = Counter(r["shard"] for r in placed if source[r["id"]] == name)
        assert all(abs(per[s] - total / 8) <= 1 + len(set(source.values())) / 2 for s in range(8))
    assert sorted(r["position"] for r in placed) == list(range(1003))


def test_same_seed_same_places(spark):
    rows = [(i, "a", "x") for i in range(50)]
    first, again, other = ({r["id"]: r["position"] for r in place(spark, rows, seed=s)} for s in (1, 1, 2))
    assert first == again != other


def test_nulls_ties_few_rows_and_none(spark):
    rows = [(None, None, None), (None, None, None), (1, "", "x"), (1, None, "x"), (2, "a", "x")]
    placed = place(spark, rows, keep=("shard",))
    assert sorted(r["position"] for r in placed) == list(range(5)) and {r["slot"] for r in placed} == {0}
    assert sorted(str(r["row"]["shard"]) for r in placed) == ["None", "None", "x", "x", "x"]
    assert place(spark, []) == []


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a", f"t{i}") for i in range(20)], "doc_id bigint, source string, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["row"]["doc_id"], r["row"]["text"]) for r in back.collect()} == {(i, f"t{i}") for i in range(20)}
    assert Counter(r["shard"] for r in back.collect()) == {s: 5 for s in range(4)}
