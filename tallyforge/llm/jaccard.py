"""Near duplicates by the Jaccard similarity of distinct five-word shingles.

Texts with the same set of shingles are one node. A node has the SimHash of its set, and
pairs within ``RADIUS`` bits of it are candidates, found by the covering masks of
``simhash`` without false negatives. As 64 bits cannot tell a similarity of 0.8, pairs
that agree on a whole band of MinHashes of the set are candidates too: two sets of
similarity s agree on one of ``BANDS`` bands of ``ROWS`` with probability
1 - (1 - s^ROWS)^BANDS, whatever their difference looks like, and 5 in 10^8 of the pairs
at 0.8 are missed. Each candidate is confirmed by the exact similarity of the two sets (of
64-bit shingle hashes), or not needed because confirmed links connect its two nodes already.

A bucket is first tested as a star round the node that meets the most others in all
buckets, so a large group of near copies gives as many pairs as it has nodes. Of buckets
that the confirmed links leave in several components, each node takes its rarest shingles
to a prefix join with bounds by position. It misses no similar pair, and members of
a family that have more shingles of their own than the similarity allows do not meet in it. Hot
shingles and hot roots are dealt to several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import contracted
from tallyforge.llm.simhash import RADIUS, majority, masks, words
from tallyforge.llm.tables import attach, copies_of, dealt, durable

SHINGLE = 5
#: The least similarity, as numerator and denominator.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
#: What a SimHash keeps in each covering table.
MASKS = np.array(masks(RADIUS), np.uint64)
#: Shingles whose MinHashes are taken at a time.
AT_ONCE = 1 << 12

_rng = np.random.default_rng(20)
_FACTORS, _FLIPS, _STEPS = (_rng.integers(0, 1 << 64, n, np.uint64) for n in (BANDS * ROWS, BANDS * ROWS, SHINGLE))
_FACTORS, _STEPS = _FACTORS | np.uint64(1), _STEPS | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word runs; of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    found = words(text)
    hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    size = min(SHINGLE, len(found))
    if not size:
        return hashes
    total = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        total += hashes[i : len(found) - size + 1 + i] * _STEPS[i]
    return np.unique(_mix(total))


def node_of(hashes: np.ndarray) -> int:
    """The name of a set, as a signed long; zero for the empty one."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0


def bands(hashes: np.ndarray) -> np.ndarray:
    """One bucket for each band of MinHashes, as signed longs; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), AT_ONCE):
        own = (hashes[i : i + AT_ONCE] ^ _FLIPS[:, None]) * _FACTORS[:, None]
        np.minimum(least, own.min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mix(out + column)
    return out.view(np.int64)


def tables(hashes: np.ndarray) -> np.ndarray:
    """One bucket for each covering table of the set's SimHash, as signed longs; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    kept = MASKS & np.uint64(majority(hashes))
    return _mix(_mix(kept) + np.arange(BANDS, BANDS + len(MASKS), dtype=np.uint64)).view(np.int64)


def _prints(rows: DataFrame) -> DataFrame:
    """``id``, ``node``, ``size`` of the set and its ``buckets``, of ``id`` and ``text``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = rows.select("id", F.lit(0).cast("long").alias("node"), F.lit(0).alias("size"), F.array(F.lit(0).cast("long")).alias("buckets")).schema
    schema = to_arrow_schema(wanted)

    def run(batches):
        for batch in batches:
            nodes, sizes, buckets = [], [], []
            for value in batch.column("text"):
                own = shingle_set(value.as_py())
                nodes.append(node_of(own))
                sizes.append(len(own))
                buckets.append(np.concatenate((tables(own), bands(own))))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(buckets, schema.field("buckets").type)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(schema.field("id").type), *columns], schema=schema)

    return rows.mapInArrow(run, wanted)


def _sets(rows: DataFrame) -> DataFrame:
    """``node`` and its ``hashes``, of ``text``."""

    def run(batches):
        for batch in batches:
            own = [shingle_set(value.as_py()) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["node", "hashes"])

    return rows.select("text").mapInArrow(run, "node long, hashes array<long>")


def _sizes_allow(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y).cast("long") * LEAST[1] >= F.greatest(x, y).cast("long") * LEAST[0]


def _sets_of(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``node`` and its ``hashes`` for the distinct nodes ``wanted``; only their texts are read again."""
    reread = nodes.join(wanted, "node", "left_semi").select("least").distinct()
    texts = rows.join(reread, F.col("id").eqNullSafe(F.col("least")), "left_semi")
    # An id may have further texts, and a text further rows.
    return durable(_sets(texts).join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def _side(sets: DataFrame, end: str) -> DataFrame:
    return sets.select(F.col("node").alias(end), F.col("hashes").alias(f"{end}_set"))


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are of similarity ``LEAST`` or more; ``pairs`` is read more than once.

    ``nodes`` has each node's ``least`` id, and ``rows`` has ``id`` and ``text``; only the
    texts of nodes in ``pairs`` are read again.
    """
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, rows)
    # The pairs of a hot node are dealt to several tasks, each with a copy of its set.
    total = pairs.count()
    copies = copies_of(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", total)
    parted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), copies).cast("int").alias("part"))
    copied = _side(sets, "a").select("a", "a_set", F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    both = parted.join(copied, ["a", "part"]).join(_side(sets, "b"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("a_set", "b_set")).cast("long").alias("shared"), (F.size("a_set") + F.size("b_set")).cast("long").alias("total"))
    return durable(shared.where(F.col("shared") * LEAST[1] >= (F.col("total") - F.col("shared")) * LEAST[0]).select("a", "b"))


def linked(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component) of all nodes that confirmed candidates connect to others."""
    shared = nodes.select("node", "size", F.explode("buckets").alias("bucket"))
    sizes = durable(shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("m", F.col("n")))
    met = durable(dealt(shared, sizes, "bucket", "node", nodes.count() * (BANDS + len(MASKS))))
    # What a family was copied from meets the most of it, so it is the one to test the others against.
    central = met.groupBy("node").agg(F.sum("m").alias("meets"))
    scored = met.join(central, "node")
    roots = durable(scored.groupBy("bucket").agg(F.max(F.struct("meets", "node", "size")).alias("root"), F.count(F.lit(1)).alias("n")))
    members = durable(dealt(met.drop("m"), roots, "bucket", "node", met.count()))
    star = members.where(F.col("node") != F.col("root.node")).where(_sizes_allow(F.col("size"), F.col("root.size")))
    edges = confirmed(durable(star.select(F.col("root.node").alias("a"), F.col("node").alias("b")).distinct()), nodes, rows)
    found = contracted(edges)
    mixed = durable(_mixed(members, found))
    if mixed.isEmpty():
        return found
    rest = durable(_apart(_prefixes(mixed, _sets_of(mixed.select("node"), nodes, rows))))
    if rest.isEmpty():
        return found
    stars = found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return contracted(stars.unionByName(confirmed(rest, nodes, rows)))


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``node``, ``size`` and ``component`` of the nodes of buckets that confirmed links leave in several components."""
    labelled = durable(members.join(found, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("component")))
    ends = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    several = durable(ends.where("low != high").select("bucket", "n"))
    return dealt(labelled, several, "bucket", "node", labelled.count()).select("node", "size", "component").distinct()


def _prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each node, the shingles (``bucket``) of which one is the first that it shares with any similar node.

    Shingles are in one order for all nodes, the rarest first, and ``at`` is the place in
    it, from 0. After the first common one at the places i and j, sets x and y have at most
    least(|x| - i, |y| - j) in common, but similar ones have 4/9 (|x| + |y|) and so 4/5 |x|.
    """
    every = sets.select("node", F.explode("hashes").alias("bucket"))
    often = durable(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("often", F.col("n")))
    common = dealt(every, often, "bucket", "node", nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    listed = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "bucket"))).alias("common"))
    # Shingles that no other node has come first and meet nothing.
    placed = nodes.join(listed, "node").withColumn("own", F.col("size") - F.size("common"))
    least, whole = LEAST
    most = F.floor(F.col("size") * (whole - least) / whole).cast("int") + 1 - F.col("own")
    first = placed.where(most > 0).select("node", "size", "component", "own", F.posexplode(F.slice("common", F.lit(1), most)).alias("place", "shingle"))
    return first.select("shingle.bucket", "node", "size", "component", (F.col("own") + F.col("place")).alias("at"))


def _positions_allow(x: Column, x_at: Column, y: Column, y_at: Column) -> Column:
    """Whether sets of these sizes whose first common shingle is there can be similar enough."""
    least, whole = LEAST
    return F.least(x - x_at, y - y_at).cast("long") * (least + whole) >= (x + y).cast("long") * least


def _apart(prefixes: DataFrame) -> DataFrame:
    """Distinct pairs of nodes of different components that meet in a bucket at places that allow similarity.

    One of a pair is outside the bucket's largest component, so a large group of copies
    costs its size for each other node.
    """
    labelled = durable(prefixes)
    total = labelled.count()
    sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    mixed = durable(mixed.select("bucket", F.col("most.component").alias("major"), "n"))
    inside = dealt(labelled, mixed, "bucket", "node", total)
    inside = durable(inside.withColumn("copies", copies_of(mixed, "bucket", total)))
    named = lambda df, end: df.select("bucket", "part", "major", *[F.col(c).alias(f"{end}_{c}") for c in ("node", "size", "component", "at")])
    x = named(inside.where("component != major").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))), "a").drop("major")
    y = named(inside.withColumn("part", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int")), "b")
    pairs = x.join(y, ["bucket", "part"]).where("a_component != b_component and (b_component = major or a_node < b_node)")
    pairs = pairs.where(_positions_allow(*[F.col(c) for c in ("a_size", "a_at", "b_size", "b_at")]))
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``component`` (smallest id reachable by pairs of similarity ``LEAST``) for every row.

    Null and wordless texts are one component. Null ids are never the smallest unless a
    component has no other. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    prints = durable(_prints(rows))
    nodes = durable(prints.groupBy("node").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.count(F.lit(1)).alias("n")))
    members = durable(nodes.select("node", "least").join(linked(nodes, rows), "node"))
    smallest = members.groupBy("component").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("n"))
    placed = dealt(members.select("node", "component"), smallest, "component", "node", members.count()).select("node", "smallest")
    # Nodes without a link are components of their own.
    labels = durable(nodes.join(placed, "node", "left").select("node", F.coalesce("smallest", "least").alias("component"), "n"))
    return attach(prints.select("id", "node"), labels, ["node"], prints.count()).select("id", "component")
