"""The request grammar: a JSON-like dict, checked strictly, as frozen dataclasses.

Absent and null are the same for optional clauses, but for ``limit`` (null: all rows)
and ``min_shards`` (null is refused). Messages name the clause and never its value.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from tallyforge.errors import malformed
from tallyforge.functions.canonical import ColumnType
from tallyforge.functions.lsn import parse_lsn

IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
AGGREGATES = ("sum", "count", "min", "max", "avg")
PREDICATES = ("eq", "neq", "gt", "gte", "lt", "lte", "between", "is")
RANKED = ("avg", "count", "sum")


@dataclass(frozen=True)
class Aggregate:
    op: str
    col: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias if self.alias is not None else f"{self.op}({self.col or '*'})"


@dataclass(frozen=True)
class Predicate:
    col: str
    op: str
    value: Any


@dataclass(frozen=True)
class Join:
    table: str
    left: str
    right: str
    variant: str | None = None


@dataclass(frozen=True)
class Rank:
    agg: str
    direction: str = "desc"


@dataclass(frozen=True)
class Request:
    qid: str
    table: str
    select: tuple[Aggregate, ...]
    where: tuple[Predicate, ...] = ()
    group_by: tuple[str, ...] = ()
    join: Join | None = None
    limit: int | None = None
    rank_by: Rank | None = None
    min_shards: int | None = None
    coverage_mode: str = "best_effort"
    read_plane: str | None = None
    min_lsn: str | None = None
    snapshot: str | None = None
    types: Mapping[str, ColumnType] = field(default_factory=dict)
    raw: dict = field(default_factory=dict, compare=False, repr=False)


def _identifier(value: Any, what: str) -> str:
    if not isinstance(value, str) or not IDENTIFIER.fullmatch(value):
        raise malformed(f"{what} must be a plain identifier")
    return value


def _only(value: Any, keys: tuple[str, ...], what: str) -> dict:
    if not isinstance(value, dict):
        raise malformed(f"{what} must be an object")
    if set(value) - set(keys):
        raise malformed(f"{what} takes only {', '.join(keys)}")
    return value


def _whole(value: Any, least: int) -> bool:
    return type(value) is int and value >= least


def _aggregate(entry: Any) -> Aggregate:
    if not isinstance(entry, dict):
        raise malformed("select entries must be objects")
    op, col, alias = entry.get("op"), entry.get("col"), entry.get("alias")
    if op not in AGGREGATES:
        raise malformed("select op must be sum, count, min, max or avg")
    if "alias" in entry and not isinstance(alias, str):
        raise malformed("select alias must be a string")
    if op != "count" and col is None:
        raise malformed("select needs a col; bare columns are not offered")
    if "col" in entry:
        _identifier(col, "select col")
    return Aggregate(op, col, alias)


def _predicate(entry: Any) -> Predicate:
    if not isinstance(entry, dict):
        raise malformed("where entries must be objects")
    col, op = _identifier(entry.get("col"), "where col"), entry.get("op")
    if op not in PREDICATES:
        raise malformed("where op must be eq, neq, gt, gte, lt, lte, between or is")
    if "value" not in entry:
        raise malformed("where needs a value")
    value = entry["value"]
    if op == "between" and (not isinstance(value, list | tuple) or len(value) != 2):
        raise malformed("where between needs two bounds")
    if op == "is" and not (value is None or isinstance(value, bool)):
        raise malformed("where is takes null, true or false")
    return Predicate(col, op, tuple(value) if op == "between" else value)


def _join(value: Any, table: str) -> Join:
    _only(value, ("table", "type", "on", "variant"), "join")
    dim = _identifier(value.get("table"), "join table")
    if dim == table:
        raise malformed("join table must be another table")
    if value.get("type") != "inner":
        raise malformed("join type must be inner")
    on = _only(value.get("on"), ("left", "right"), "join on")
    left, right = _identifier(on.get("left"), "join on left"), _identifier(on.get("right"), "join on right")
    if "variant" in value and value["variant"] != "tier2":
        raise malformed("join variant must be tier2")
    return Join(dim, left, right, value.get("variant"))


def _rank(value: Any) -> Rank:
    _only(value, ("agg", "direction"), "rank_by")
    if not isinstance(value.get("agg"), str) or not value["agg"]:
        raise malformed("rank_by agg must name an aggregate")
    if "direction" in value and value["direction"] not in ("asc", "desc"):
        raise malformed("rank_by direction must be asc or desc")
    return Rank(value["agg"], value.get("direction", "desc"))


def _refuse_unoffered(query: dict) -> None:
    if query.get("having") is not None:
        raise malformed("having is not offered")
    if query.get("orderBy") not in (None, []):
        raise malformed("orderBy is not offered; see rank_by")
    if query.get("offset") is not None and (query["offset"] != 0 or query["offset"] is False):
        raise malformed("offset is not offered")
    if query.get("distinct") is not None and query["distinct"] is not False:
        raise malformed("distinct is not offered")


def _limit(query: dict) -> int | None:
    if "limit" in query and "fetch_rows" in query:
        raise malformed("limit and fetch_rows exclude each other")
    for name, least in (("limit", 0), ("fetch_rows", 1)):
        if name in query:
            if query[name] is not None and not _whole(query[name], least):
                raise malformed(f"{name} must be null or an integer of {least} or more")
            return query[name]
    return None


def _types(raw: dict) -> dict[str, ColumnType]:
    """Column types that the request declares: ``column_types`` with ``column_scales``."""
    kinds, scales = (raw.get(k) or {} for k in ("column_types", "column_scales"))
    for value, what in ((kinds, "column_types"), (scales, "column_scales")):
        if not isinstance(value, dict):
            raise malformed(f"{what} must be an object")
        for column in value:
            _identifier(column, f"{what} key")
    return {c: ColumnType(k, scales.get(c, 0) if k == "numeric" else 0) for c, k in kinds.items()}


def parse_request(raw: Any) -> Request:
    """A checked request, or an ``EngineError`` of code malformed."""
    if not isinstance(raw, dict):
        raise malformed("the request must be an object")
    if type(raw.get("v")) is not int or raw["v"] != 1:
        raise malformed("v must be 1")
    if not isinstance(raw.get("qid"), str) or not raw["qid"]:
        raise malformed("qid must be a non-empty string")
    table = _identifier(raw.get("table"), "table")
    if raw.get("coverage_mode") not in (None, "best_effort", "fail_fast"):
        raise malformed("coverage_mode must be best_effort or fail_fast")
    if "directory_snapshot" in raw and not isinstance(raw["directory_snapshot"], str):
        raise malformed("directory_snapshot must be a string")
    plane, floor = raw.get("read_plane"), raw.get("min_lsn")
    if plane not in (None, "primary", "replica"):
        raise malformed("read_plane must be primary or replica")
    if floor is not None and (plane != "replica" or parse_lsn(floor) is None):
        raise malformed("min_lsn must be a log position and needs read_plane replica")
    query = raw.get("query")
    if not isinstance(query, dict):
        raise malformed("query must be an object")
    select = query.get("select")
    if not isinstance(select, list) or not select:
        raise malformed("select must be a non-empty list")
    aggregates = tuple(map(_aggregate, select))
    where, group_by = query.get("where"), query.get("groupBy")
    if where is not None and not isinstance(where, list):
        raise malformed("where must be a list")
    predicates = tuple(map(_predicate, where or ()))
    if group_by is not None and not isinstance(group_by, list):
        raise malformed("groupBy must be a list")
    keys = tuple(_identifier(k, "groupBy entry") for k in group_by or ())
    _refuse_unoffered(query)
    join = _join(query["join"], table) if query.get("join") is not None else None
    limit = _limit(query)
    if "min_shards" in query and not _whole(query["min_shards"], 1):
        raise malformed("min_shards must be a positive integer")
    rank = _rank(query["rank_by"]) if query.get("rank_by") is not None else None
    return Request(
        raw["qid"], table, aggregates, predicates, keys, join, limit, rank, query.get("min_shards"),
        raw.get("coverage_mode") or "best_effort", plane, floor, raw.get("directory_snapshot"), _types(raw), raw,
    )
