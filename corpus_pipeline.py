"""The corpus pipeline: five stages from raw documents to tokens.

Each stage takes ``(spark, docs, sf_dir)`` and all rows that its predecessor kept;
all but the last return the columns of ``documents``, extra ones included. Empty
tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import bpe, decontaminate, jaccard, quality, secrets_scan
from tallyforge.llm.tables import read, small_batches, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; those without words are rejected."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id (null last), then text hash.

    A group is what pairs of a similarity (Jaccard of distinct five-word shingles) of 0.8
    or more connect. Of wholly equal (id, text) rows, one stays.
    """
    small_batches(spark)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    found = jaccard.near_duplicates(docs.select(key.alias("key"), "text"), row_id="key")
    kept = found.select(F.col("component").alias("key")).distinct()
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return keyed.join(kept, "key", "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and ``n_chars`` counted anew."""
    return secrets_scan.redact(docs, secrets_scan.default_forest(spark))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` text."""
    import public_tokenizers

    small_batches(spark)
    ranks = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return decoded.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("tokens", tokenise),
]

#: The classifier and the forest are trained, so SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
