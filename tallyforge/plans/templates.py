"""Named plan shapes over the engine's tables, called with checked parameters.

A template is a DataFrame builder with declared parameters; its name stands for a
digest of its declaration and body, so a caller that pins the digest notices a change.
Templates that return rows are cut to ``min(limit, max_rows)`` and say so. A builder is
checked when it is registered: one expression over the tables it is given, no action.
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import textwrap
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.errors import EngineError, malformed
from tallyforge.operators.join import join_dimension
from tallyforge.operators.rank import largest_first
from tallyforge.plans.planner import Template
from tallyforge.plans.request import IDENTIFIER, Join
from tallyforge.sources.cold import cold_scan

# Bytes of parameters that a call may have, and rows that a template returns at most.
MAX_PARAMETER_BYTES = 8192
MAX_ROWS = 1000
SPAN = {"id_min": int, "id_max": int}
DAYS = {"dataset": str, "day_from": str, "day_to": str}
TOTAL = "decimal(38,2)"


@dataclass(frozen=True)
class Shape:
    """A template: its kind (rows or scalar), parameters, merge operations and builder."""

    name: str
    kind: str
    parameters: Mapping[str, type]
    merge_ops: tuple[str, ...]
    keys: tuple[str, ...]
    build: Callable[..., DataFrame]
    table: str = "wh_probe_agg"
    join: Join | None = None
    max_rows: int = MAX_ROWS
    schema_version: int = 1
    state: str = "active"

    @property
    def digest(self) -> str:
        """SHA-256 of what the template declares, of its body and of the functions of its module that the body uses."""
        said = [self.name, self.kind, self.table, str(self.join), {k: v.__name__ for k, v in self.parameters.items()}, self.merge_ops, self.keys, self.max_rows, self.schema_version]
        return hashlib.sha256(json.dumps([said, _body(self.build)], sort_keys=True).encode()).hexdigest()


def _body(build: Callable) -> list[str]:
    """The source of a function and of those that it reaches in its own module; its code where there is no source."""
    seen: dict[str, str] = {}
    waiting = [build]
    while waiting:
        one = waiting.pop()
        if one.__qualname__ in seen:
            continue
        try:
            seen[one.__qualname__] = inspect.getsource(one)
        except (OSError, TypeError):
            seen[one.__qualname__] = f"{one.__code__.co_code.hex()} {one.__code__.co_names} {one.__code__.co_consts}"
        named = (build.__globals__.get(n) for n in one.__code__.co_names)
        waiting += [f for f in named if inspect.isfunction(f) and f.__module__ == build.__module__]
    return sorted(seen.values())


REGISTRY: dict[str, Shape] = {}

# The merge operations that there are, and most rows that a template may declare.
MERGE_OPS = frozenset({"sum", "count", "count_col", "min", "max", "avg_pair", "topk", "raw_rows", "groupby"})
MOST_ROWS = 1_000_000
#: What a builder must not do: run a job, write, or reach for other data.
ACTIONS = frozenset({"collect", "count", "first", "head", "show", "take", "toPandas", "toLocalIterator", "foreach", "write", "writeTo", "writeStream", "checkpoint", "persist", "cache", "rdd", "sql", "read", "table", "sparkSession", "createDataFrame"})


def lint(shape: Shape) -> list[str]:
    """What is wrong with a template's declaration or body."""
    wrong = []
    if not IDENTIFIER.fullmatch(shape.name):
        wrong.append("the name is not a plain identifier")
    if shape.kind not in ("rows", "scalar"):
        wrong.append("the kind is neither rows nor scalar")
    if not shape.merge_ops or set(shape.merge_ops) - MERGE_OPS:
        wrong.append("merge operations are missing or unknown")
    if not 1 <= shape.max_rows <= MOST_ROWS:
        wrong.append("max_rows is out of range")
    if shape.kind == "rows" and shape.parameters.get("limit") is not int:
        wrong.append("a template of rows takes a limit")
    if shape.kind == "scalar" and (shape.keys or "limit" in shape.parameters):
        wrong.append("a scalar template has no keys and no limit")
    if any(t not in (int, str) or not IDENTIFIER.fullmatch(k) for k, t in shape.parameters.items()):
        wrong.append("a parameter is neither an integer nor a text")
    if list(inspect.signature(shape.build).parameters) != ["tables", "params"]:
        wrong.append("the builder does not take (tables, params)")
    try:
        (body,) = ast.parse(textwrap.dedent(inspect.getsource(shape.build))).body
    except (OSError, SyntaxError, ValueError):
        return [*wrong, "the builder has no source of its own"]
    statements = body.body if isinstance(body, ast.FunctionDef) else []
    if not statements or not isinstance(statements[-1], ast.Return) or not all(isinstance(x, ast.Assign | ast.Expr | ast.Return) for x in statements):
        wrong.append("the builder is more than assignments and a return")
    # An attribute of F is a column function, whatever its name.
    used = {n.attr for n in ast.walk(body) if isinstance(n, ast.Attribute) and not (isinstance(n.value, ast.Name) and n.value.id == "F")}
    if used & ACTIONS:
        wrong.append("the builder runs a job, writes or reads elsewhere")
    return wrong


def template(name: str, kind: str, merge_ops: tuple[str, ...], parameters: Mapping[str, type] | None = None, keys: tuple[str, ...] = (), table: str = "wh_probe_agg", join: Join | None = None):
    """Registers ``f(tables, params) -> DataFrame``; refuses what ``lint`` finds fault with."""

    def register(build):
        shape = Shape(name, kind, dict(parameters or {}), merge_ops, keys, build, table, join)
        if wrong := lint(shape):
            raise ValueError(f"template {name}: {'; '.join(wrong)}")
        REGISTRY[name] = shape
        return build

    return register


def manifest() -> list[Template]:
    """The registered templates as the planner matches them with requests."""
    return [Template(s.name, s.table, s.kind, frozenset(s.merge_ops), s.join, s.max_rows, s.schema_version, s.state, s.digest) for s in REGISTRY.values()]


def inventory(rows: Any) -> list[Template]:
    """A shard's template rows (dicts of ``Template``'s fields); one that cannot be read voids them all."""
    try:
        held = [Template(**{**r, "merge_ops": frozenset(r["merge_ops"])}) for r in rows]
        return held if all(isinstance(t.digest, str) and t.digest and type(t.max_rows) is int and type(t.schema_version) is int for t in held) else []
    except (TypeError, KeyError, AttributeError):
        return []


def _span(rows: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Rows with ``id_min <= id < id_max``; an absent or null bound is open."""
    if params.get("id_min") is not None:
        rows = rows.where(F.col("id") >= params["id_min"])
    if params.get("id_max") is not None:
        rows = rows.where(F.col("id") < params["id_max"])
    return rows


def _total(column: str):
    return F.sum(F.col(column).cast(TOTAL)).cast(TOTAL)


@template("W1", "rows", ("sum", "count"), SPAN | {"limit": int}, ("region",))
def grouped_sum_count(tables, params):
    return _span(tables["fact"], params).groupBy("region").agg(_total("amount").alias("x"), F.count(F.lit(1)).alias("c")).orderBy(F.col("region").asc_nulls_last())


@template("W2", "scalar", ("min", "max", "count_col"), SPAN)
def scalar_min_max(tables, params):
    return _span(tables["fact"], params).agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count("amount").alias("c"))


@template("W3", "scalar", ("avg_pair",), SPAN)
def scalar_average(tables, params):
    return _span(tables["fact"], params).agg(_total("amount").alias("s"), F.count("amount").alias("c"))


@template("W4", "rows", ("topk",), {"limit": int})
def top_k(tables, params):
    return largest_first(tables["fact"], "amount", "id")


@template("W5", "scalar", ("sum", "count_col"), DAYS, table="facts_blocks")
def cold_sum(tables, params):
    rows = cold_scan(tables["blocks"], params.get("dataset"), params.get("day_from"), params.get("day_to"))
    return rows.agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(38,4)").alias("x"), F.count("value").alias("c"))


def _dim(variant: str | None = None) -> Join:
    return Join("wh_probe_dim", "region", "region", variant)


def _joined(tables, variant: str | None, *aggregates):
    rows = join_dimension(tables["fact"], tables["dim"], Join("dim", "region", "region", variant))
    return rows.groupBy("region").agg(*aggregates).orderBy(F.col("region").asc_nulls_last())


@template("W6", "rows", ("sum", "count", "count_col"), {"limit": int}, ("region",), join=_dim())
def joined_sums(tables, params):
    return _joined(tables, None, _total("amount").alias("x"), F.count("amount").alias("c"), F.count(F.lit(1)).alias("n"))


@template("W7", "rows", ("sum", "count", "count_col"), {"limit": int}, ("region",), join=_dim("tier2"))
def tier_sums(tables, params):
    return _joined(tables, "tier2", _total("amount").alias("x"), F.count("amount").alias("c"), F.count(F.lit(1)).alias("n"))


@template("W8", "rows", ("avg_pair", "count", "count_col"), {"limit": int}, ("region",), join=_dim("tier2"))
def tier_averages(tables, params):
    return _joined(tables, "tier2", _total("amount").alias("s"), F.count("amount").alias("c"), F.count(F.lit(1)).alias("n"))


def check_parameters(shape: Shape, params: Any) -> dict:
    """The parameters, if they are those that the template declares and of their types."""
    if not isinstance(params, dict) or len(json.dumps(params, default=str).encode()) > MAX_PARAMETER_BYTES:
        raise malformed("parameters must be a small object")
    for key, value in params.items():
        wanted = shape.parameters.get(key)
        if wanted is None:
            raise malformed("the template has no such parameter")
        if value is not None and (type(value) is not wanted):
            raise malformed("a parameter has another type")
    if params.get("limit") is not None and params["limit"] < 0:
        raise malformed("limit must not be negative")
    return params


@dataclass
class Called:
    """Rows of a template; ``truncated`` counts all rows only when asked for."""

    shape: Shape
    rows: DataFrame
    uncut: DataFrame
    kept: int | None

    def truncated(self) -> bool:
        """Whether there were more rows than were kept."""
        return self.kept is not None and self.uncut.limit(self.kept + 1).count() > self.kept


def call(name: str, tables: Mapping[str, DataFrame], params: Any = None, digest: str | None = None) -> Called:
    """Runs a registered, active template."""
    shape = REGISTRY.get(name)
    if shape is None or shape.state not in ("active", "frozen"):
        raise EngineError("plan_untemplated", "no such template")
    if digest is not None and digest != shape.digest:
        raise EngineError("plan_untemplated", "the template is not the one that was pinned")
    params = check_parameters(shape, params or {})
    every = shape.build(tables, params)
    if shape.kind == "scalar":
        return Called(shape, every, every, None)
    limit = params.get("limit")
    kept = shape.max_rows if limit is None else min(limit, shape.max_rows)
    return Called(shape, every.limit(kept), every, kept)
