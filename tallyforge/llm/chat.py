"""Collapse of cumulative conversation logs, then chat rendering.

Loggers often store a conversation again after each turn, so many logged
conversations are prefixes of longer ones. Every turn gets a hash of its place, role
and text; the running XOR along the conversation is its rolling prefix hash (128
bits as two longs). A conversation whose whole hash is the hash of a shorter prefix
of another is dropped by an anti-join, and of equal conversations the smallest id
stays. Only hashes are shuffled for that; turns are never gathered in one row until
the retained conversations are rendered, in parts of a bounded number of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.tables import read, stored

#: Turn numbers rendered into one output row; a longer conversation has several parts.
TURNS_PER_PART = 512

#: Turn numbers in a stretch, within which turns are ordered in one task.
STRETCH = 1024

# The ChatML markers.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _rows(conversations: DataFrame, stretch: int) -> DataFrame:
    """Logged turns with ``content``, the digest of role and text, ``key`` and ``stretch``.

    ``key`` names the conversation; a row without an id is one of its own. ``stretch`` is
    the turn number's; turns without a number come first, by digest, and so do their stretches.
    """
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.octet_length(c).cast("string"), F.lit(":"), F.col(c)))
    rows = conversations.select("conv_id", "turn", "role", "text", F.md5(F.concat(part("role"), F.lit("|"), part("text"))).alias("content"))
    alone = F.concat_ws("/", F.lit("-"), F.col("turn").cast("string"), "content")
    unnumbered = F.conv(F.substring("content", 1, 3), 16, 10).cast("long") - 4096
    return rows.withColumn("key", F.when(F.col("conv_id").isNull(), alone).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))).withColumn(
        "stretch", F.when(F.col("turn").isNull(), unnumbered).otherwise(F.floor(F.col("turn") / stretch).cast("long"))
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """Each distinct turn's ``conv_id``, ``key``, ``place``, ``n_turns`` and prefix hashes ``hi``, ``lo``.

    Wholly equal rows of a conversation are one turn. Turns are ordered by turn number
    (null first) and the digest of role and text, and placed from 1; null role and text
    are kept apart from empty ones. Nothing says which rows with a null conv_id belong
    together, so each distinct one is a conversation of one turn. Turn numbers are not negative.

    Places and prefix hashes are taken within stretches of turn numbers and carried on
    by the counts and hashes of earlier stretches, so a long conversation is not one
    task. Texts are digested where they are read and never shuffled.
    """
    rows = _rows(conversations, STRETCH).select("conv_id", "key", "stretch", "turn", "content").distinct()
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("key", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("key")).alias("n_turns"))
    order = Window.partitionBy("key", "stretch").orderBy("turn", "content")
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    marked = (
        rows.withColumn("nth", F.row_number().over(order))
        .join(counts, ["key", "stretch"])
        .withColumn("place", F.col("before") + F.col("nth"))
        .withColumn("digest", F.md5(F.concat(F.col("place").cast("string"), F.lit("|"), F.col("content"))))
        .select("conv_id", "key", "stretch", "turn", "content", "place", "n_turns", half(1).alias("h"), half(17).alias("l"))
    )
    whole = marked.groupBy("key", "stretch").agg(F.bit_xor("h").alias("h"), F.bit_xor("l").alias("l"))
    carried = whole.select("key", "stretch", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in "hl"])
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        marked.withColumn("h_here", F.bit_xor("h").over(so_far))
        .withColumn("l_here", F.bit_xor("l").over(so_far))
        .join(carried, ["key", "stretch"])
        .select("conv_id", "key", "place", "n_turns", F.col("h_here").bitwiseXOR(F.col("h_before")).alias("hi"), F.col("l_here").bitwiseXOR(F.col("l_before")).alias("lo"))
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """``key``, ``conv_id``, ``n_turns`` and ``n_logged`` (equal logs) of conversations that no longer one extends.

    Of equal conversations that with the smallest id stays, a null id last.
    """
    found = prefixes(conversations)
    # One row per distinct conversation and per distinct prefix before the join, so a hot one costs nothing.
    name = F.struct(F.col("conv_id").isNull().alias("unnamed"), "conv_id", "key")
    whole = found.where("place = n_turns").groupBy("place", "hi", "lo").agg(F.min(name).alias("least"), F.count(F.lit(1)).alias("n_logged"))
    extended = found.where("place < n_turns").select("place", "hi", "lo").distinct()
    kept = whole.join(extended, ["place", "hi", "lo"], "left_anti")
    return kept.select("least.key", "least.conv_id", F.col("place").cast("long").alias("n_turns"), "n_logged")


def render(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """ChatML text of the maximal conversations: ``conv_id``, ``part``, ``n_turns``, ``n_logged``, ``text``.

    ``part`` is the turn number divided by ``turns_per_part``, below zero for null turn
    numbers; joining the parts in order gives the whole. Null roles and texts render as
    empty. Empty input gives no rows.

    The kept conversations' parts are stored first, so their size is known: where it is
    small they are broadcast and no dropped text moves, and else texts move once, by part.
    """
    rows = _rows(conversations, turns_per_part)
    kept = maximal(conversations).drop("conv_id")
    wanted = stored(rows.select("key", F.col("stretch").alias("part")).distinct().join(kept, "key"))
    turn = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    said = F.struct("turn", "content", turn.alias("said"))
    ours = rows.withColumnRenamed("stretch", "part").join(wanted, ["key", "part"])
    parts = ours.groupBy("key", "part", "conv_id", "n_turns", "n_logged").agg(F.array_sort(F.array_distinct(F.collect_list(said))).alias("all"))
    return parts.select("conv_id", "part", "n_turns", "n_logged", F.array_join("all.said", "").alias("text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered maximal conversations of the whole table."""
    return render(read(spark, sf_dir, "conversations"))


OP10_SQL = f"""
WITH rows AS (
  SELECT DISTINCT conv_id, turn, role, text, md5(
    coalesce('+' || strlen(role)::VARCHAR || ':' || role, '-') || '|' || coalesce('+' || strlen(text)::VARCHAR || ':' || text, '-')) AS content
  FROM conversations),
keyed AS (SELECT *, CASE WHEN conv_id IS NULL THEN concat_ws('/', '-', turn::VARCHAR, content) ELSE '=' || conv_id END AS key FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, content) AS place FROM keyed),
prefixes AS (
  SELECT key, conv_id, place, string_agg(content, '/') OVER (PARTITION BY key ORDER BY place) AS prefix,
    max(place) OVER (PARTITION BY key) AS n_turns FROM placed),
whole AS (
  SELECT prefix, arg_min(key, (conv_id IS NULL, conv_id, key)) AS key, max(n_turns) AS n_turns, count(*) AS n_logged
  FROM prefixes WHERE place = n_turns GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE place < n_turns))
SELECT p.conv_id, CAST(coalesce(p.turn // {TURNS_PER_PART}, ('0x' || substr(p.content, 1, 3))::BIGINT - 4096) AS BIGINT) AS part,
  CAST(k.n_turns AS BIGINT) AS n_turns, k.n_logged,
  string_agg('{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10), '' ORDER BY place) AS text
FROM placed p JOIN kept k USING (key)
GROUP BY p.key, 1, 2, 3, 4
"""
