"""From a request to a plan: typed columns, shards to read, join gates, template names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from tallyforge.errors import EngineError, malformed
from tallyforge.functions.canonical import ColumnType
from tallyforge.plans.request import RANKED, Aggregate, Join, Predicate, Rank, Request


#: States of a placement that serves.
LIVE = ("serving", "draining")


@dataclass(frozen=True)
class DirectoryRow:
    """One placement that may serve a table."""

    shard: str
    key_min: str | None = None
    key_max: str | None = None
    hash_slot: int | None = None
    state: str = "serving"
    schema_version: int = 1
    row_estimate: int | None = None
    is_reference: bool = False
    platform_status: str = "ACTIVE_HEALTHY"
    last_health_at: datetime | None = None


@dataclass(frozen=True)
class ShardKey:
    """How a table is spread over shards."""

    kind: str = "none"
    column: str = ""
    type: ColumnType | None = None
    slot_of: Callable[[Any], int] | None = None


@dataclass(frozen=True)
class Plan:
    """What to compute; ``aggregates`` by result name."""

    table: str
    keys: tuple[tuple[str, ColumnType], ...]
    aggregates: Mapping[str, tuple[Aggregate, ColumnType | None]]
    where: tuple[tuple[Predicate, ColumnType | None], ...] = ()
    join: Join | None = None
    rank: Rank | None = None
    limit: int | None = None

    @property
    def grouped(self) -> bool:
        return bool(self.keys)


def build_plan(request: Request, types: Mapping[str, ColumnType]) -> Plan:
    """Checks the request against the column types."""
    if len(set(request.group_by)) < len(request.group_by):
        raise malformed("groupBy names a column twice")
    for column in (*request.group_by, *(a.col for a in request.select if a.col)):
        if column not in types:
            raise malformed("a column of select or groupBy has no type")
    aggregates: dict[str, tuple[Aggregate, ColumnType | None]] = {}
    for a in request.select:
        if a.name in aggregates:
            raise malformed("two aggregates have one name")
        kind = types[a.col] if a.col else None
        if a.op != "count" and kind.name not in ("int8", "numeric"):
            raise malformed(f"{a.op} needs an int8 or numeric column")
        aggregates[a.name] = (a, kind)
    if request.rank_by:
        if not request.group_by:
            raise malformed("rank_by needs a grouped query")
        if request.rank_by.agg not in aggregates:
            raise malformed("rank_by names no aggregate of the query")
        if aggregates[request.rank_by.agg][0].op not in RANKED:
            raise malformed("rank_by takes avg, count or sum")
    where = tuple((p, types.get(p.col)) for p in request.where)
    return Plan(request.table, tuple((k, types[k]) for k in request.group_by), aggregates, where, request.join, request.rank_by, request.limit)


def select_shards(rows: Sequence[DirectoryRow], where: Sequence[Predicate], key: ShardKey) -> list[DirectoryRow]:
    """Shards whose span may hold matching rows.

    Bounds of several predicates intersect. A shard that only touches a bound stays;
    so does one whose own bounds cannot be read. ``neq`` and ``is`` exclude nothing.
    """
    mine = [p for p in where if p.col == key.column]
    if key.kind == "hash":
        wanted = next((p for p in mine if p.op == "eq"), None)
        if wanted is None or key.slot_of is None:
            return list(rows)
        try:
            slot = key.slot_of(wanted.value)
        except Exception:  # noqa: BLE001  a value that has no slot cannot be routed
            return list(rows)
        return [r for r in rows if r.hash_slot == slot]
    if key.kind not in ("range", "time"):
        return list(rows)
    if key.type is None:
        raise TypeError("a range needs the type of its key")
    low = high = None
    for p in mine:
        if p.op in ("neq", "is"):
            continue
        first, last = (key.type.parse(v) for v in (p.value if p.op == "between" else (p.value, p.value)))
        if p.op == "between" and None not in (first, last) and first > last:
            raise malformed("between has its bounds reversed")
        if p.op in ("eq", "between", "gt", "gte") and first is not None:
            low = first if low is None else max(low, first)
        if p.op in ("eq", "between", "lt", "lte") and last is not None:
            high = last if high is None else min(high, last)

    def touched(row: DirectoryRow) -> bool:
        try:
            begin, end = key.type.parse(row.key_min), key.type.parse(row.key_max)
        except EngineError:
            return True
        return not (high is not None and begin is not None and begin > high or low is not None and end is not None and end < low)

    return [r for r in rows if touched(r)]


@dataclass(frozen=True)
class Template:
    """A registered plan shape that may serve a request."""

    name: str
    table: str
    kind: str
    merge_ops: frozenset[str]
    join: Join | None = None
    max_rows: int = 1000
    schema_version: int = 1
    state: str = "active"
    digest: str = ""


def plan_ops(plan: Plan) -> frozenset[str]:
    """The merge operations that a plan needs."""
    return frozenset({"avg": "avg_pair", "count": "count" if a.col is None else "count_col"}.get(a.op, a.op) for a, _ in plan.aggregates.values())


def derive_templates(plan: Plan, templates: Sequence[Template], schema_version: int | None = None) -> list[Template]:
    """Templates of the plan's table, kind, join class and variant that merge all it needs."""
    kind, needed = "rows" if plan.grouped else "scalar", plan_ops(plan)
    return [
        t for t in templates
        if t.state == "active" and t.table == plan.table and t.kind == kind
        and (t.join is None) == (plan.join is None) and (t.join is None or t.join.variant == plan.join.variant)
        and needed <= t.merge_ops and schema_version in (None, t.schema_version)
    ]


def check_handshake(needed: Sequence[Template], held: Sequence[Template], schema_version: int, limit: int | None) -> str | None:
    """Why a shard whose inventory is ``held`` cannot run the needed templates; None if it can."""
    by_digest = {t.digest: t for t in held}
    for template in needed:
        own = by_digest.get(template.digest)
        if own is None or own.state not in ("active", "frozen"):
            return "template_missing"
        if own.schema_version != schema_version:
            return "schema_mismatch"
        if limit is not None and own.max_rows < limit:
            return "max_rows_exceeded"
    return None


def sampled(qid: str) -> bool:
    """Whether a request is one of the sixteenth for which shards' inventories are read."""
    return hashlib.sha256(qid.encode()).digest()[0] & 15 == 7


def check_join(plan: Plan, derived: Sequence[Template], templates: Sequence[Template], shards: Sequence[DirectoryRow], dims: Sequence[DirectoryRow] | None) -> None:
    """The join gates in their order: template class, dimension, keys, co-location.

    Where no template derives, the dimension and keys must be those of some join template
    of the table, if it has any: a join that no template knows is refused, not guessed.
    """
    join = plan.join
    if join is None:
        return
    if derived and derived[0].join is None:
        raise EngineError("join_template_required", "the template does not join")
    bound = [t.join for t in derived[:1]] or [t.join for t in templates if t.table == plan.table and t.join]
    if bound:
        bound = [b for b in bound if b.table == join.table]
        if not bound:
            raise EngineError("join_template_required", "no template joins that dimension")
        if all((b.left, b.right) != (join.left, join.right) for b in bound):
            raise EngineError("join_key_mismatch", "the template joins on other columns")
    if not dims or not all(d.is_reference is True for d in dims):
        raise EngineError("join_not_colocated", "the dimension is not a reference table")
    for shard in shards:
        if sum(d.shard == shard.shard and d.state in LIVE for d in dims) != 1:
            raise EngineError("join_not_colocated", "a shard has no single copy of the dimension")


def estimate(row: DirectoryRow) -> int | None:
    """A placement's row estimate, if it has one; zero is none."""
    return row.row_estimate if type(row.row_estimate) is int and row.row_estimate > 0 else None


def covers_whole_spans(rows: Sequence[DirectoryRow], where: Sequence[Predicate], key: ShardKey) -> bool:
    """Whether the predicates keep all rows of these placements: none, or ranges of the shard key round their spans."""
    if not where:
        return True
    if key.kind not in ("range", "time") or key.type is None or any(p.col != key.column or p.op in ("eq", "neq", "is") for p in where):
        return False
    try:
        for row in rows:
            begin, end = key.type.parse(row.key_min), key.type.parse(row.key_max)
            for p in where:
                low, high = (key.type.parse(v) for v in (p.value if p.op == "between" else (p.value, p.value)))
                below = p.op in ("gt", "gte", "between") and (begin is None or low is None or begin < low or p.op == "gt" and begin == low)
                above = p.op in ("lt", "lte", "between") and (end is None or high is None or end > high)  # ends are excluded
                if below or above:
                    return False
    except EngineError:
        return False
    return True
