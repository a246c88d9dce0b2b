"""The join of facts with a reference dimension, and overlap joins of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.plans.request import Join


def join_dimension(facts: DataFrame, dim: DataFrame, join: Join) -> DataFrame:
    """Facts with a dimension row, by inner equi-join; the dimension's columns are not kept.

    ``tier2`` keeps dimension rows of tier 2, before the join. No side is named for a
    broadcast: the planner broadcasts the keys if their bytes are under the session's
    threshold, as files or once read, and else joins by shuffle.
    """
    if join.variant == "tier2":
        dim = dim.where(F.col("tier") == 2)
    keys = dim.select(F.col(f"`{join.right}`").alias("__right"))
    return facts.join(keys, facts[join.left] == F.col("__right"), "inner").drop("__right")


def before(low: Column, high: Column) -> Column:
    """Whether a span's start lies before another's end; null is unbounded."""
    return low.isNull() | high.isNull() | (low < high)


def overlapping(left: DataFrame, right: DataFrame, low: str, high: str, extra: Column | None = None) -> DataFrame:
    """Pairs of half-open spans that share a point; touching spans do not.

    Aliases ``a`` and ``b`` name the sides in ``extra``. Meant for catalogue tables.
    """
    a, b = left.alias("a"), right.alias("b")
    meets = before(F.col(f"a.{low}"), F.col(f"b.{high}")) & before(F.col(f"b.{low}"), F.col(f"a.{high}"))
    return a.join(b, meets if extra is None else meets & extra)
