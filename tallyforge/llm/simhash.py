"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is set if over half of the text's shingle hashes
have it set. For radius r, each bit position is given a non-zero vector of r + 1
binary digits, and there is one table for each non-zero vector v, whose mask keeps
the positions with an odd inner product with v. The at most r positions where two
fingerprints differ leave a v that is orthogonal to all of their vectors, so that
table's mask keeps none of them: every pair within the radius collides in some table
(Pagh, "CoveringLSH: Locality-sensitive hashing without false negatives").

Equal fingerprints are one node from the start. Within a bucket nodes are linked by a
search that takes each found node out at once, so a bucket gives fewer links than
nodes, never all of its pairs, and keeps every connection. A bucket of more than
``BUCKET_LIMIT`` nodes is split by covering masks on the bits that it left open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.components import components
from tallyforge.llm.tables import attach, durable, read

SEED = 42
SHINGLE, RADIUS = 3, 3
#: Nodes of a bucket that one search takes; larger buckets are split further.
BUCKET_LIMIT = 1 << 16
#: Hashes turned into bits at a time.
HASHES_AT_ONCE = 1 << 16


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, split at space and \\x09-\\x0D; none for null."""
    return [] if text is None else text.encode().lower().split()


def shingles(found: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; the whole sequence where it is shorter."""
    if size == 1 or not found:
        return found
    if len(found) < size:
        return [b" ".join(found)]
    return [b" ".join(run) for run in zip(*(found[i:] for i in range(size)))]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some unsigned 64-bit hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        octets = hashes[i : i + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(votes, seed: int = SEED) -> int:
    """The SimHash of some shingles; zero for none."""
    from xxhash import xxh64_intdigest

    return majority(np.fromiter((xxh64_intdigest(v, seed) for v in votes), np.uint64))


def masks(radius: int, among: int = (1 << 64) - 1) -> list[int]:
    """Masks on the bits of ``among``: for any ``radius`` of them, some mask has none."""
    places = [i for i in range(64) if among >> i & 1]
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << p for n, p in enumerate(places) if (1 + n % vectors & v).bit_count() & 1) for v in range(1, vectors + 1)]


def signed(value: int) -> int:
    """A 64-bit pattern as a signed integer."""
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``print``, the fingerprint of every ``shingle`` consecutive words as a signed long."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = rows.select("id", F.lit(0).cast("long").alias("print")).schema
    schema = to_arrow_schema(wanted)

    def run(batches):
        for batch in batches:
            found = [fingerprint(shingles(words(value.as_py()), shingle)) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(schema.field("id").type), pa.array(np.array(found, np.uint64).view(np.int64))], schema=schema)

    return rows.mapInArrow(run, wanted)


def _search(prints: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(root, members) of what is linked within a bucket of distinct fingerprints."""
    left, out = np.arange(len(prints)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        group, waiting = [], [root]
        while waiting and len(left):
            near = np.bitwise_count(prints[left] ^ prints[waiting.pop()]) <= radius
            if near.any():
                hit = left[near]
                group.append(hit)
                waiting.extend(hit.tolist())
                left = left[~near]
        if group:
            out.append((int(root), np.concatenate(group)))
    return out


def _linked(keyed: DataFrame, radius: int, limit: int | None) -> DataFrame:
    """Links (``a``, ``b``) within buckets of equal (table, bucket); with ``limit``, the rows
    of larger buckets come back as ``open`` instead, with their table and ``a``."""
    names = ["open", "table", "a", "b"]

    def batch_of(is_open: bool, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), is_open)), pa.array(table.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    def flush(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        """Links of whole buckets."""
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        sizes = np.diff(np.append(starts, len(keys)))
        pair = starts[sizes == 2]
        pair = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= radius]
        a, b = [prints[pair]], [prints[pair + 1]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = prints[start : start + size]
            for root, members in _search(own, radius):
                a.append(np.repeat(own[root], len(members)))
                b.append(own[members])
        a, b = np.concatenate(a), np.concatenate(b)
        return batch_of(False, np.zeros(len(a)), a, b)

    def run(batches):
        keys, prints = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        overfull = None
        for batch in batches:
            new_keys = np.stack([batch.column("table").to_numpy().astype(np.int64), batch.column("bucket").to_numpy()], axis=1)
            new_prints = batch.column("print").to_numpy().view(np.uint64)
            if overfull is not None and len(new_keys):
                same = (new_keys == overfull).all(axis=1)
                if same.any():
                    yield batch_of(True, new_keys[same, 0], new_prints[same], new_prints[same])
                    new_keys, new_prints = new_keys[~same], new_prints[~same]
            if not len(new_keys):
                continue
            keys, prints = np.concatenate((keys, new_keys)), np.concatenate((prints, new_prints))
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if last:
                yield flush(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
            if limit is not None and len(keys) > limit:
                overfull = keys[0].copy()
                yield batch_of(True, keys[:, 0], prints, prints)
                keys, prints = keys[:0], prints[:0]
        if len(keys):
            yield flush(keys, prints)

    dealt = keyed.repartition("table", "bucket").sortWithinPartitions("table", "bucket", "print")
    return dealt.select("table", "bucket", "print").mapInArrow(run, "open boolean, table int, a long, b long")


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(signed(v)) for v in values])


def links(prints: DataFrame, radius: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) of distinct fingerprints (``print``) that connect what all pairs within the radius connect.

    A bucket that is split holds, after the split, fingerprints that agree on the bits of
    two masks; for the radius 3 those leave 16 bits open at most, which bounds it.
    """
    tables = masks(radius)
    entries = F.array(*[F.struct(F.lit(i).alias("table"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("bucket")) for i, m in enumerate(tables)])
    keyed = prints.select("print", F.explode(entries).alias("e")).select("e.table", "e.bucket", "print")
    found = durable(_linked(keyed, radius, bucket_limit))
    edges, again = found.where(~F.col("open")), found.where("open")
    if not again.isEmpty():
        # Buckets that are too large: the same scheme on the bits that their mask left open.
        inner = F.array(*[_array([m | sub for sub in masks(radius, ((1 << 64) - 1) ^ m)]) for m in tables])
        split = again.select("table", F.col("a").alias("print"), F.posexplode(F.element_at(inner, F.col("table") + 1)).alias("sub", "mask"))
        split = split.select((F.col("table") * len(tables) + F.col("sub")).alias("table"), F.col("print").bitwiseAND(F.col("mask")).alias("bucket"), "print")
        edges = edges.unionByName(durable(_linked(split, radius, None)))
    return edges.select("a", "b")


def digits(value: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, row_id: str = "doc_id", text: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``id``, ``fingerprint`` (hex), ``component`` (smallest id reachable) for every row.

    Rows with a null or wordless text have fingerprint zero and are linked like others.
    Rows with equal ids stay apart but share their component's id; null ids are never
    the smallest unless a component has no other. An empty table gives no rows; other
    columns are not read.
    """
    prints = durable(fingerprints(docs, shingle, row_id, text))
    # Partial aggregation by fingerprint, so a hot group of copies is one row per task.
    nodes = durable(prints.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    members = durable(nodes.join(components(links(nodes, radius, bucket_limit)).withColumnRenamed("node", "print"), "print").select("print", "least", "component"))
    smallest = members.groupBy("component").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("n"))
    placed = attach(members.select("print", "component"), smallest, ["component"], members.count()).select("print", "smallest")
    # Fingerprints without a link are components of their own.
    labels = durable(nodes.join(placed, "print", "left").select("print", F.coalesce("smallest", "least").alias("component"), "n"))
    return attach(prints, labels, ["print"], prints.count()).select("id", digits(F.col("print")).alias("fingerprint"), "component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, radius 3."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))
