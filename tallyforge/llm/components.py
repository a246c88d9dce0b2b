"""Connected components of an edge table, on the cluster.

Alternates large-star and small-star steps (Kiveris et al., "Connected Components
in MapReduce and Beyond"): each step links a node's neighbours to the smallest of
them, so the graph turns into stars round each component's smallest node in a
logarithmic number of rounds. Only edges move, those of a star's centre stay where
they are, and nothing is gathered on the driver but one count and checksum per round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.tables import attach, dealt, durable

#: Edges that one task contracts at a time.
EDGES_AT_ONCE = 1 << 20


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour ``m`` and its ``n`` edges."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("m", F.least("m", "a"))
    return attach(both, least, ["a"], 2 * total).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    least = _least(down)
    # Of a star, each node but the centre has one smaller neighbour, so no node is hot here.
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node it reaches.

    Nodes may be of any type that can be ordered; loops and repeated edges do no harm.
    Nodes without an edge to another are not in the result.
    """
    stars = durable(_small_star(edges.select("a", "b")))
    state = _state(stars)
    while state[0]:
        stars = durable(_small_star(_large_star(stars, state[0])))
        before, state = state, _state(stars)
        if state == before:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges and the smallest that it reaches by them."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # The ends of an edge and the nodes that they are labelled with get the smaller label.
        for end in (x, y):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def _stars(edges: DataFrame, at_once: int) -> DataFrame:
    """Of each ``at_once`` edges in a task, every ``node`` and the smallest that it reaches by them, its ``centre``."""

    def star(held):
        a, b = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b"))
        node, centre = _forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(centre)], names=["node", "centre"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= at_once:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "node long, centre long")


def contracted(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """What ``components`` gives, for nodes that are longs, in fewer stages.

    Each task contracts its own edges to stars, so a node has few rows however many edges
    it has. Centres of one node are then connected: up to ``at_once`` such edges by
    one task, more by ``components``, with the same result.
    """
    stars = _stars(edges.where("a != b"), at_once).groupBy("node").agg(F.collect_set("centre").alias("centres"))
    stars = durable(stars.select("node", F.array_min("centres").alias("low"), "centres"))
    between = durable(stars.where(F.size("centres") > 1).select(F.explode("centres").alias("a"), F.col("low").alias("b")).where("a != b").distinct())
    n = between.count()
    if not n:
        return stars.select("node", F.col("low").alias("component"))
    joined = _stars(between.coalesce(1), n + 1).withColumnRenamed("centre", "component") if n <= at_once else components(between)
    lows = stars.groupBy("low").agg(F.count(F.lit(1)).alias("n"))
    labels = durable(lows.join(joined.withColumnRenamed("node", "low"), "low", "left").withColumn("component", F.coalesce("component", "low")))
    return durable(dealt(stars.select("node", "low"), labels, "low", "node", stars.count()).select("node", "component"))
