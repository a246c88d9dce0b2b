"""Proportional stratified interleaving of rows into shards.

Rows of each stratum are shuffled by a seeded hash and ranked; a row's fractional
rank is ``(2 * rank - 1) / (2 * rows in the stratum)``. Sorting all rows by it
interleaves the strata in proportion, so cutting the order into equal runs gives
shards that each have the mixture of the whole, with row counts at most one apart.

No stratum is ranked in one task: ranks are row numbers within (stratum, hash
bucket) plus the count of the stratum's earlier buckets, and positions are row
numbers within a slice of fractional ranks plus the closed-form count of all rows
in earlier slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the shuffle hash (three hex digits) and slices of the fractional rank.
BUCKETS = 4096
LAW = "rows"


def _stratum(column: Column) -> Column:
    """A join key that keeps null apart from every string."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, row_id: str = "doc_id", stratum: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``id``, ``row`` (struct of ``keep``), ``position``, ``shard``, ``slot``.

    Null ids and null strata count as a value of their own; rows with equal ids are
    ordered by the kept columns, and wholly equal rows are interchangeable. An empty
    input gives no rows. Columns that are not named do not take part, so their names
    cannot clash.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    ident = F.col(f"`{row_id}`")
    rows = docs.select(
        ident.alias("id"),
        _stratum(F.col(f"`{stratum}`")).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))).alias("order_hash"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"),
    ).withColumn("bucket", F.conv(F.substring("order_hash", 1, 3), 16, 10).cast("int"))

    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "stratum",
        "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("n_stratum"),
    )
    here = Window.partitionBy("stratum", "bucket").orderBy("order_hash", "id", "row")
    ranked = (
        rows.withColumn("at", F.row_number().over(here))
        .join(counts, ["stratum", "bucket"])
        .withColumn("rank", F.col("before") + F.col("at"))
        .withColumn("slice", F.expr(f"cast(((2 * rank - 1) * {BUCKETS}) div (2 * n_stratum) as int)"))
        .withColumn("fraction", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("n_stratum")).cast("double"))
    )

    totals = counts.groupBy("stratum").agg(F.max("n_stratum").alias("n"))
    slices = (
        totals.select("n", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("slice"))
        # rows of a stratum in earlier slices: those with (2 r - 1) * BUCKETS < 2 n slice
        .withColumn("fewer", F.expr(f"((2 * n * slice + {BUCKETS - 1}) div {BUCKETS}) div 2"))
        .groupBy("slice")
        .agg(F.sum("fewer").alias("offset"), F.sum("n").alias("n_rows"))
    )
    within = Window.partitionBy("slice").orderBy("fraction", "stratum", "rank")
    placed = ranked.withColumn("nth", F.row_number().over(within)).join(slices, "slice").withColumn("position", F.col("offset") + F.col("nth") - 1)
    return placed.withColumn("shard", F.expr(f"cast((position * {shards}) div n_rows as int)")).select(
        "id",
        "row",
        F.col("position").cast("long").alias("position"),
        "shard",
        F.expr(f"cast(position - (shard * n_rows + {shards - 1}) div {shards} as long)").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17, row_id: str = "doc_id", stratum: str = "source") -> None:
    """Writes whole rows as Parquet, one folder ``shard=N`` each, in slot order within a file."""
    placed = interleave(docs, shards, seed, row_id, stratum, keep=docs.columns)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in eight shards under the ``rows`` law."""
    from tallyforge.llm.tables import read

    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return interleave(docs, keep=("size", "text_crc32")).select(
        F.col("id").alias("doc_id"),
        "row.size",
        "row.text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP2_SQL = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
      lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) g(i))),
d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum,
    md5('17:' || coalesce(doc_id::VARCHAR, '')) AS order_hash,
    CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS hx,
    coalesce(strlen(text), 0) AS n_bytes
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY order_hash, doc_id, size) AS k,
    count(*) OVER (PARTITION BY stratum) AS n FROM d),
p AS (
  SELECT *, row_number() OVER (
      ORDER BY ((2 * k - 1) * {BUCKETS}) // (2 * n), (2 * k - 1)::DOUBLE / (2 * n)::DOUBLE, stratum, k) - 1 AS pos,
    count(*) OVER () AS total FROM r)
SELECT doc_id, size,
  CAST(xor(list_reduce(list_concat([4294967295], list_transform(range(n_bytes), lambda b: ('0x' || substr(hx, 2 * b + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS BIGINT) AS text_crc32,
  'rows' AS law, CAST((pos * 8) // total AS INTEGER) AS shard,
  CAST(pos - (((pos * 8) // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p, crc_table
"""
