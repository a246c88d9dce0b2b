"""Reading the corpus tables, cutting lineage where every executor can see it, and
joins that a hot key does not turn into one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker, where the session leaves Spark's default.
BATCH_KEY, DEFAULT_BATCH, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"
#: A key is hot if more than this part of all rows have it, so there are fewer hot keys than this.
HOT_PARTS = 1000
#: Copies of a row that one array stands for.
COPIES_AT_ONCE = 4096


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small; a value that the session set itself stays."""
    if spark.conf.get(BATCH_KEY, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_KEY, SMALL_BATCH)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name``; ``sf_dir`` may be any path that Spark can read."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> None:
    """Names a checkpoint folder if the context has none.

    It is the session's ``spark.checkpoint.dir``. Only a local session may have none and
    gets a temporary folder; on a cluster no executor would see the others' files there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyforge-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared checkpoint folder, with its lineage cut."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read from there."""
    spark = df.sparkSession
    context = spark.sparkContext
    _shared_folder(spark)
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def attach(rows: DataFrame, labels: DataFrame, keys: Sequence[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``labels``, which has one row for each value of ``keys``.

    ``labels`` also has ``n``, the rows that have that key, and ``total`` is the rows of
    all keys or more. Labels of hot keys, fewer than ``HOT_PARTS`` by that count, are
    broadcast, so their rows stay where they are; the others meet by shuffle. ``n`` is
    not in the result. Both inputs are read more than once.
    """
    keys = list(keys)
    hot = labels.where(F.col("n") * HOT_PARTS > total).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    cold = labels.where(F.col("n") * HOT_PARTS <= total).drop("n")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys, how))


def copies_of(counts: DataFrame, key: str, total: int) -> Column:
    """To how many tasks the rows of a value of ``key`` are dealt: one, or more where it is hot.

    ``counts`` has ``n``, the rows of each value, of ``total`` in all. The hot ones, fewer
    than ``HOT_PARTS`` by that count, come to the driver and are part of the expression, so
    no row goes through a join to learn that it is not hot. ``counts`` is read at once.
    """
    kind = counts.schema[key].dataType
    hot = counts.where(F.col("n") * HOT_PARTS > total).select(key, _parts(total)).collect()
    if not hot:
        return F.lit(1)
    keys = [F.lit(value).cast(kind) for value, _ in hot]
    parts = F.create_map(*[x for k, (_, n) in zip(keys, hot) for x in (k, F.lit(n))])
    return F.when(F.col(key).isin(*keys), F.element_at(parts, F.col(key))).otherwise(1)


def _parts(total: int) -> Column:
    """The tasks that rows of a hot key are dealt to, ``n`` of ``total``."""
    return (F.col("n") * HOT_PARTS / total).cast("int") + 1


def dealt(rows: DataFrame, labels: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """What ``attach`` gives, with rows of a hot key dealt to several tasks by their column ``by``.

    Each of those tasks has a copy of the label. Rows are read once and all are moved;
    there are half as many tasks and fewer stages. ``labels`` is read more than once.
    """
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(by), copies_of(labels, key, total)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("n") * HOT_PARTS > total, _parts(total)).otherwise(1) - 1))
    return parted.join(labels.withColumn("_part", each).drop("n"), [key, "_part"]).drop("_part")


def each_copy(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says, which goes; arrays are short."""
    outer = F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(COPIES_AT_ONCE).cast("long"))
    inner = F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES_AT_ONCE).cast("long"), F.col(times) - F.col("_from")))
    return rows.where(F.col(times) > 0).select("*", F.explode(outer).alias("_from")).select("*", F.explode(inner).alias("_copy")).drop("_from", "_copy", times)
