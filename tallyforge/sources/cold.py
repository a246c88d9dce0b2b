"""The cold tier: events of a day packed into columnar blocks, verified and rolled off.

A block is one row with parallel arrays of up to ``BLOCK_ROWS`` events and the ranges
of its times and devices. Events are numbered within (day, id bucket) plus the count
of earlier buckets, so a day is cut into blocks without one task holding it all.
Events without a time or id are packed like others, the former under a null day.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows in a block, the dataset, and the sizes that call for roll-off.
BLOCK_ROWS = 1000
DATASET = "events"
SEAL_BYTES = 425_000_000
#: Ids per bucket by which events are numbered.
BUCKET_IDS = 1_000_000

BLOCK_COLUMNS = ("dataset", "day", "chunk", "n_rows", "ts_min", "ts_max", "dev_min", "dev_max", "ts", "d", "m", "v", "id")


class SealError(Exception):
    """A roll-off step that was stopped; the source rows are untouched."""


def seal_due(size_bytes: int) -> bool:
    """Whether the hot tier has outgrown its mark."""
    return size_bytes > SEAL_BYTES


def pack(events: DataFrame) -> DataFrame:
    """Blocks of events (id, ts, device_id, metric, value), by UTC day, in id order."""
    rows = events.select("id", "ts", "device_id", "metric", "value", F.to_date("ts").alias("day"), F.floor(F.col("id") / BUCKET_IDS).cast("long").alias("bucket"))
    counts = rows.groupBy("day", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("day").alias("_day"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("day", "bucket").orderBy("id"))
    numbered = rows.withColumn("nth", nth).join(counts, F.col("day").eqNullSafe(F.col("_day")) & F.col("bucket").eqNullSafe(F.col("_bucket")))
    chunked = numbered.withColumn("chunk", F.floor((F.col("before") + F.col("nth") - 1) / BLOCK_ROWS).cast("long") + 1)
    packed = chunked.groupBy("day", "chunk").agg(
        F.count(F.lit(1)).cast("int").alias("n_rows"),
        F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.min("device_id").alias("dev_min"), F.max("device_id").alias("dev_max"),
        F.array_sort(F.collect_list(F.struct("id", "ts", "device_id", "metric", "value"))).alias("e"),
    )
    arrays = [F.col(f"e.{c}").alias(a) for c, a in (("ts", "ts"), ("device_id", "d"), ("metric", "m"), ("value", "v"), ("id", "id"))]
    return packed.select(F.lit(DATASET).alias("dataset"), *BLOCK_COLUMNS[1:8], *arrays)


def unpack(blocks: DataFrame) -> DataFrame:
    """Blocks as events again: ``ts``, ``device_id``, ``metric``, ``value``, ``id``."""
    return blocks.select(F.inline(F.arrays_zip("ts", "d", "m", "v", "id"))).toDF("ts", "device_id", "metric", "value", "id")


def cold_scan(blocks: DataFrame, dataset: str | None, day_from: str | None = None, day_to: str | None = None) -> DataFrame:
    """Events of blocks of a dataset with ``day_from <= day < day_to``; without a dataset, none."""
    kept = blocks.where(F.col("dataset") == F.lit(dataset) if dataset is not None else F.lit(False))
    if day_from is not None:
        kept = kept.where(F.col("day") >= F.lit(day_from).cast("date"))
    if day_to is not None:
        kept = kept.where(F.col("day") < F.lit(day_to).cast("date"))
    return unpack(kept)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Writes blocks partitioned by dataset and day; days that are packed anew are replaced."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "day").parquet(path)


def id_checksums(rows: DataFrame) -> DataFrame:
    """``day`` and ``checksum``: the MD5 of the day's ids, sorted as numbers and joined by commas, null ids left out.

    The digest is sequential by definition, so a day is one task; it reads the sorted ids
    batch by batch and holds none but the batch.
    """
    def run(batches):
        day, digest = None, None
        for batch in batches:
            days = batch.column("day").to_pylist()
            ids = batch.column("id").cast(pa.string()).to_pylist()
            begin = 0
            while begin < len(days):
                end = bisect.bisect_right(range(len(days)), 0, begin, key=lambda i: days[i] != days[begin])
                if digest is None or days[begin] != day:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([day], pa.date32()), pa.array([digest.hexdigest()])], names=["day", "checksum"])
                    day, digest = days[begin], hashlib.md5(usedforsecurity=False)
                else:
                    digest.update(b",")
                digest.update(",".join(ids[begin:end]).encode())
                begin = end
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([day], pa.date32()), pa.array([digest.hexdigest()])], names=["day", "checksum"])

    own = rows.select("day", F.col("id").cast("long").alias("id")).where(F.col("id").isNotNull())
    return own.repartition("day").sortWithinPartitions("day", "id").mapInArrow(run, "day date, checksum string")


def source_state(events: DataFrame) -> DataFrame:
    """Count, checksum and ranges by day."""
    dated = events.withColumn("day", F.to_date("ts"))
    state = dated.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.min("device_id").alias("dev_min"), F.max("device_id").alias("dev_max"))
    sums = id_checksums(dated).withColumnRenamed("day", "_day")
    return state.join(sums, F.col("day").eqNullSafe(F.col("_day")), "left").drop("_day")


def blocks_checksum(blocks: DataFrame) -> DataFrame:
    """The checksum by day, computed anew from the blocks' ids; refuses blocks without all their ids."""
    if blocks.where(F.col("id").isNull() | F.exists("id", lambda i: i.isNull())).limit(1).count():
        raise SealError("a block lacks ids, so its checksum would say nothing")
    return id_checksums(blocks.select("day", F.explode("id").alias("id")))


def verify_day(blocks: DataFrame, day: str, expected: str) -> int:
    """The number of a day's blocks, if their checksum is the expected one."""
    own = blocks.where(F.col("day") == F.lit(day).cast("date"))
    n = own.count()
    if not n:
        raise SealError("the day has no blocks")
    if blocks_checksum(own).first()["checksum"] != expected:
        raise SealError("checksum mismatch")
    return n


def remaining(events: DataFrame, blocks: DataFrame, day: str) -> DataFrame:
    """``events`` without just those of the day that the blocks hold; one that came later stays."""
    at = F.lit(day).cast("date")
    here = F.coalesce(F.to_date("ts") == at, F.lit(False))
    packed = unpack(blocks.where(F.col("day") == at)).select(F.col("id").alias("_id"), F.col("ts").alias("_ts"))
    late = events.where(here).join(packed, (F.col("id") == F.col("_id")) & (F.col("ts") == F.col("_ts")), "left_anti")
    return events.where(~here).unionByName(late)


def roll_off_day(events: DataFrame, blocks: DataFrame, day: str, staging: str) -> tuple[dict, DataFrame, DataFrame]:
    """Packs a day, verifies the blocks and removes just the packed events.

    The fresh blocks are written once under ``staging``, a folder that all executors see,
    and everything after reads them there. Returns a report, the events that stay and the
    blocks as they then are. A day that fails to verify, or in which an event came while it
    was packed, is a ``SealError`` and nothing is removed. Unlike a count taken before
    packing, the number of removed rows is compared with the fresh blocks'.
    """
    at = F.lit(day).cast("date")
    window, others = events.where(F.to_date("ts") == at), blocks.where(F.coalesce((F.col("day") != at) | (F.col("dataset") != DATASET), F.lit(True)))
    source = source_state(window).first()
    if source is None:
        old = blocks.where((F.col("day") == at) & (F.col("dataset") == DATASET))
        state = old.agg(F.count(F.lit(1)).alias("b"), F.sum("n_rows").alias("n")).first()
        if not state["b"]:
            return {"status": "empty", "day": day}, events, blocks
        checksum = blocks_checksum(old).first()["checksum"]
        return {"status": "already_done", "day": day, "blocks": state["b"], "n_rows": state["n"], "checksum": checksum, "from_blocks": True}, events, blocks
    path = f"{staging}/{uuid.uuid4().hex}"
    pack(window).write.parquet(path)
    fresh = events.sparkSession.read.parquet(path)
    n_blocks = verify_day(fresh, day, source["checksum"])
    n_rows = fresh.agg(F.sum("n_rows")).first()[0]
    left = remaining(window, fresh, day).count()
    if left or n_rows != source["n_rows"]:
        raise SealError("the day changed while it was packed")
    report = {"status": "rolled_off", "day": day, "blocks": n_blocks, "from_blocks": False} | {k: source[k] for k in ("n_rows", "checksum", "ts_min", "ts_max", "dev_min", "dev_max")}
    return report, remaining(events, fresh, day), others.unionByName(fresh.select(*others.columns))
