"""Joins with hot keys, and the folder that lineage is cut in."""

from __future__ import annotations

import pytest

from tallyforge.llm import tables


@pytest.mark.parametrize(("total", "how"), [(10, "inner"), (10**9, "inner"), (3000, "inner"), (3000, "left")])
def test_attach_equals_a_join(spark, total, how):
    rows = spark.createDataFrame([("h", i) for i in range(40)] + [("c", 1), ("d", 2), ("lone", 3)], "k string, v int")
    labels = spark.createDataFrame([("h", "hot", 40), ("c", "cold", 1), ("d", "cold", 1), ("none", "x", 1)], "k string, label string, n long")
    want = rows.join(labels.drop("n"), "k", how)
    got = tables.attach(rows, labels, ["k"], total, how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("total", [10**9, 5000, 3000, 43])
def test_dealt_equals_a_join_and_joins_no_row_to_learn_that_it_is_not_hot(spark, total):
    rows = spark.createDataFrame([(-7, i) for i in range(40)] + [(1 << 40, 1), (2, 2), (3, 3), (None, 4)], "k long, v long")
    labels = spark.createDataFrame([(-7, "hot", 40), (1 << 40, "cold", 1), (2, "cold", 1), (9, "x", 1)], "k long, label string, n long")
    want = rows.join(labels.drop("n"), "k")
    got = tables.dealt(rows, labels, "k", "v", total)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_copies_of_hot_keys_only(spark):
    counts = spark.createDataFrame([(-7, 40), (1 << 40, 5), (2, 1)], "k long, n long")
    rows = spark.createDataFrame([(-7,), (1 << 40,), (2,), (3,), (None,)], "k long")
    for total, want in ((10**9, {}), (3000, {-7: 14, 1 << 40: 2}), (43, {-7: 931, 1 << 40: 117, 2: 24})):
        assert {r["k"]: r["c"] for r in rows.select("k", tables.copies_of(counts, "k", total).alias("c")).collect()} == {k: want.get(k, 1) for k in (-7, 1 << 40, 2, 3, None)}


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        tables._shared_folder(Session())
