"""Exact two-phase aggregation.

Partials are sums, counts, minima and maxima for each shard and group; merging them
in any order and any grouping gives the same totals, and a merged partial is itself
a partial. An average is carried as its exact sum and count and divided by no one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.errors import ShardError
from tallyforge.functions.canonical import ColumnType
from tallyforge.plans.planner import Plan
from tallyforge.plans.request import Aggregate, Predicate

SHARD = "__shard"
#: Partials of one aggregate, by its number in the plan: sum, count, least, greatest.
SUM, COUNT, LEAST, GREATEST = "s", "c", "lo", "hi"


def total_type(kind: ColumnType) -> str:
    """Sums never wrap: integers add up as decimals."""
    return f"decimal(38,{kind.scale if kind.name == 'numeric' else 0})"


def condition(predicate: Predicate, kind: ColumnType | None) -> Column:
    """A predicate as a column; null rows satisfy ``is null`` alone."""
    column = F.col(f"`{predicate.col}`")
    if predicate.op == "is":
        return column.isNull() if predicate.value is None else column.eqNullSafe(F.lit(predicate.value))
    lit = kind.literal if kind else F.lit
    if predicate.op == "between":
        low, high = predicate.value
        return (column >= lit(low)) & (column <= lit(high))
    value = lit(predicate.value)
    return {"eq": column == value, "neq": column != value, "gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[predicate.op]


def _parts(number: int, aggregate: Aggregate, kind: ColumnType | None) -> list[Column]:
    name = lambda part: f"__{part}{number}"
    if aggregate.op == "count":
        return [F.count(F.lit(1) if aggregate.col is None else F.col(f"`{aggregate.col}`")).alias(name(COUNT))]
    column = F.col(f"`{aggregate.col}`").cast(kind.sql)
    if aggregate.op in ("min", "max"):
        return [F.min(column).alias(name(LEAST))] if aggregate.op == "min" else [F.max(column).alias(name(GREATEST))]
    parts = [F.sum(column.cast(total_type(kind))).cast(total_type(kind)).alias(name(SUM))]
    return parts + ([F.count(column).alias(name(COUNT))] if aggregate.op == "avg" else [])


def _grouped(df: DataFrame, keys: Sequence[Column], parts: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*parts) if keys else df.agg(*parts)


def partials(rows: DataFrame, plan: Plan, by_shard: bool = False) -> DataFrame:
    """Partial aggregates by group, and by the column ``__shard`` if asked for."""
    for predicate, kind in plan.where:
        if predicate.col not in rows.columns:
            raise ShardError(status=400)
        if predicate.op == "is" and predicate.value is not None and not isinstance(rows.schema[predicate.col].dataType, T.BooleanType):
            raise ShardError(status=400)
        rows = rows.where(condition(predicate, kind))
    keys = [F.col(f"`{k}`").cast(t.sql).alias(f"__k{i}") for i, (k, t) in enumerate(plan.keys)]
    parts = [p for i, (a, t) in enumerate(plan.aggregates.values()) for p in _parts(i, a, t)]
    return _grouped(rows, ([F.col(SHARD)] if by_shard else []) + keys, parts)


def merge(partial: DataFrame, plan: Plan) -> DataFrame:
    """Partials merged over shards: one row for each group, or exactly one for a scalar plan."""
    parts = []
    for name in partial.columns:
        if name == SHARD or name.startswith("__k"):
            continue
        part = name.lstrip("_").rstrip("0123456789")
        if part == COUNT:
            parts.append(F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name))
        elif part == SUM:
            parts.append(F.sum(name).cast(partial.schema[name].dataType).alias(name))
        else:
            parts.append((F.min if part == LEAST else F.max)(name).alias(name))
    return _grouped(partial, [F.col(f"__k{i}") for i in range(len(plan.keys))], parts)


def doubtful(plan: Plan) -> Column:
    """Whether a partial row cannot be true: a count that is null or negative, a sum that is there without rows or missing with them."""
    wrong = F.lit(False)
    for i, (a, _) in enumerate(plan.aggregates.values()):
        count, total = F.col(f"__{COUNT}{i}"), F.col(f"__{SUM}{i}")
        if a.op in ("count", "avg"):
            wrong = wrong | count.isNull() | (count < 0)
        if a.op == "avg":
            wrong = wrong | (total.isNull() != (count == 0))
    return F.coalesce(wrong, F.lit(True))


def adapted(given: DataFrame, plan: Plan) -> DataFrame:
    """Named partials of a shard as this plan's; refuses a missing column or one that would lose something."""
    fields = {f.name: f.dataType for f in given.schema}

    def column(name: str, wanted: str, alias: str) -> Column:
        if name not in fields:
            raise ShardError(code=f"envelope_invalid: no column {name}")
        exact = isinstance(fields[name], T.NullType | T.IntegralType | T.DecimalType) if wanted.startswith(("decimal", "bigint")) else True
        if not exact:
            raise ShardError(code=f"envelope_invalid: column {name} is not exact")
        return F.col(f"`{name}`").cast(wanted).alias(alias)

    part = {"sum": SUM, "min": LEAST, "max": GREATEST}
    columns = [column(k, t.sql, f"__k{i}") for i, (k, t) in enumerate(plan.keys)]
    for i, (name, (a, t)) in enumerate(plan.aggregates.items()):
        if a.op == "avg":
            columns += [column(f"{name}_sum", total_type(t), f"__{SUM}{i}"), column(f"{name}_count", "bigint", f"__{COUNT}{i}")]
        elif a.op == "count":
            columns.append(column(name, "bigint", f"__{COUNT}{i}"))
        else:
            columns.append(column(name, total_type(t) if a.op == "sum" else t.sql, f"__{part[a.op]}{i}"))
    return given.select(*columns)


def finish(merged: DataFrame, plan: Plan) -> DataFrame:
    """Named results: an average ``x`` is ``x_num`` and ``x_den``, both null without rows."""
    columns = [F.col(f"__k{i}").alias(k) for i, (k, _) in enumerate(plan.keys)]
    for i, (name, (a, _)) in enumerate(plan.aggregates.items()):
        if a.op == "avg":
            columns += [F.col(f"__{SUM}{i}").alias(f"{name}_num"), F.when(F.col(f"__{COUNT}{i}") > 0, F.col(f"__{COUNT}{i}")).alias(f"{name}_den")]
        else:
            part = {"count": COUNT, "sum": SUM, "min": LEAST, "max": GREATEST}[a.op]
            columns.append(F.col(f"__{part}{i}").alias(name))
    return merged.select(*columns)
