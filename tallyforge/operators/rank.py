"""Canonical order, exact ranking by an aggregate, and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.aggregate import COUNT, SUM
from tallyforge.plans.planner import Plan

#: Digits of a step of the long division, and its steps after the floor: 54 digits tell
#: apart rationals of any two counts, which differ by 10 ** -38 or more.
STEP, STEPS = 18, 3
SPLIT = 19


def _ten(digits: int) -> Column:
    return F.lit(str(10**digits)).cast(f"decimal({digits + 1},0)")


def _divide(num: Column, den: Column) -> tuple[Column, Column]:
    """Whole quotient of at most 20 digits, and rest; exact, as the rest is taken off first."""
    rest = F.pmod(num, den)
    return ((num - rest) / den).cast("decimal(20,0)"), rest.cast("decimal(19,0)")


def rational_key(num: Column, den: Column) -> list[Column]:
    """Columns that order ``num / den`` exactly; ``num`` is a whole number of up to 38 digits, ``den`` a long.

    A long division whose every step fits a decimal: the upper and lower digits of the
    floor, then ``STEPS`` times ``STEP`` digits after it, where doubles would be inexact.
    """
    num, den = num.cast("decimal(38,0)"), den.cast("decimal(19,0)")
    # Split towards zero, where nothing overflows, then made a floor.
    low = (num % _ten(SPLIT)).cast("decimal(20,0)")
    high = ((num - low) / _ten(SPLIT)).cast("decimal(20,0)")
    high, low = F.when(low < 0, high - 1).otherwise(high), F.when(low < 0, low + _ten(SPLIT)).otherwise(low)
    quotient, rest = _divide(high, den)
    key = [quotient]
    for shift, added in [(SPLIT, low)] + [(STEP, F.lit(0))] * STEPS:
        quotient, rest = _divide((rest * _ten(shift) + added).cast("decimal(38,0)"), den)
        key.append(quotient)
    return key


def _whole(total: Column, scale: int) -> Column:
    """A decimal's digits as a whole number, without a product that could overflow."""
    if not scale:
        return total
    rest = total % F.lit(1).cast("decimal(1,0)")
    scaled = (rest * _ten(scale)).cast("decimal(38,0)")
    return ((total - rest).cast("decimal(38,0)") * _ten(scale)).cast("decimal(38,0)") + scaled


def order(merged: DataFrame, plan: Plan) -> DataFrame:
    """By the ranked aggregate if there is one (null last either way), then by key, null last."""
    keys = [F.col(f"__k{i}").asc_nulls_last() for i in range(len(plan.keys))]
    values: list[Column] = []
    if plan.rank:
        number = list(plan.aggregates).index(plan.rank.agg)
        aggregate, kind = plan.aggregates[plan.rank.agg]
        total, count = F.col(f"__{SUM}{number}"), F.col(f"__{COUNT}{number}")
        if aggregate.op == "avg":
            whole = _whole(total, kind.scale if kind.name == "numeric" else 0)
            values = rational_key(whole, F.when(count > 0, count))
        else:
            values = [total if aggregate.op == "sum" else count]
        values = [v.desc_nulls_last() if plan.rank.direction == "desc" else v.asc_nulls_last() for v in values]
    ordered = merged.orderBy(*values, *keys) if plan.grouped else merged
    return ordered.limit(plan.limit) if plan.grouped and plan.limit is not None else ordered


def top_rows(rows: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The first ``k`` raw rows by ``by`` descending (null last) and ``tie``, with ``pre_trim``: all rows.

    The total is counted apart, so no window gathers the rows in one task.
    """
    total = rows.agg(F.count(F.lit(1)).alias("pre_trim"))
    top = largest_first(rows, by, tie).limit(k)
    # k rows with one row; ordered again, since a later limit may drop an order below the join.
    return largest_first(top.crossJoin(F.broadcast(total)), by, tie)


def largest_first(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """Rows by ``by`` descending, null last, and ``tie``."""
    return rows.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc())
