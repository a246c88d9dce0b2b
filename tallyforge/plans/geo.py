"""Gates before a plan runs: the write fence, where reads go, and when a replica may answer."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from tallyforge.errors import EngineError
from tallyforge.functions.lsn import lsn_at_least

MUTATING = frozenset({"insert", "upsert", "update", "delete"})


@dataclass(frozen=True)
class Replica:
    project_ref: str | None
    state: str = "serving"
    applied_lsn: str | None = None
    coverage: Any = None


@dataclass(frozen=True)
class Route:
    """Where a read goes: ``placements``, ``engine_local``, ``remote``, ``replica`` or ``primary``."""

    kind: str
    target: str | None = None
    detail: str | None = None

    @property
    def warning(self) -> dict | None:
        return {"shard": self.target or "geo_replica", "code": "geo_fallback_primary", "est_rows": 0, "retried": False, "detail": self.detail} if self.detail else None


@dataclass(frozen=True)
class Planes:
    """Where reads may go besides the placements.

    ``mode`` and ``replicas`` are read for requests that ask for the replica;
    ``override`` names the project that serves as primary, and ``own`` this one.
    """

    mode: Callable[[], str | None] | None = None
    replicas: Callable[[], Sequence[Replica]] | None = None
    override: Any = None
    own: str = ""

    def route(self, wants_replica: bool, table: str, is_reference: bool | None, templated: bool, min_lsn: str | None) -> Route:
        """The plane of one request; there is never more than one."""
        if wants_replica:
            return replica_route(self.mode() if self.mode else None, self.replicas, table, is_reference, templated, min_lsn)
        return dispatch(self.override, self.own)


def is_write(raw: Any) -> bool:
    """Whether a raw request would change data: it says so by key or by operation."""
    if not isinstance(raw, dict):
        return False
    if "idempotency_key" in raw:
        return True
    query = raw.get("query")
    select = query.get("select") if isinstance(query, dict) else None
    return isinstance(select, list) and any(isinstance(e, dict) and isinstance(e.get("op"), str) and e["op"] in MUTATING for e in select)


def write_gate(config: Mapping[str, Any], carried: Any = None, has_epoch: bool = False) -> int:
    """The write epoch, if writes are open: explicitly not read-only, and of the same epoch."""
    epoch = config.get("write_epoch")
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    whole = number(carried) and carried == int(carried)
    if config.get("read_only") is not False or not number(epoch) or has_epoch and (not whole or carried != epoch):
        raise EngineError("read_only_mode", "writes are fenced")
    return epoch


def dispatch(override: Any, own: str) -> Route:
    """Where requests go that name no plane: an override that is this project runs here, with a warning."""
    if not own or not isinstance(override, str) or not override:
        return Route("placements")
    return Route("engine_local", own, "geo_promoted_primary_local") if override == own else Route("remote", override)


def covers(coverage: Any, table: str, is_reference: bool | None) -> bool:
    """Whether a replica holds all of a table: it lists it, or it lists nothing and the table is a reference."""
    if coverage is None:
        return is_reference is True
    return isinstance(coverage, list | tuple) and all(isinstance(t, str) for t in coverage) and table in coverage


def replica_route(mode: str | None, read: Callable[[], Sequence[Replica]] | None, table: str, is_reference: bool | None = None, templated: bool = False, min_lsn: str | None = None) -> Route:
    """A replica, or the primary with the first gate that failed."""
    if mode != "spread":
        return Route("primary", detail="mode_colocated")
    try:
        rows = list(read())
    except Exception:  # noqa: BLE001  a directory that cannot be read only costs the replica
        return Route("primary", detail="geo_read_error")
    serving = next((r for r in rows if r.state == "serving"), None)
    if serving is None:
        draining = next((r for r in rows if r.state == "draining"), None)
        return Route("primary", draining and draining.project_ref, "state_draining" if draining else "no_serving_row")
    if not serving.project_ref:
        return Route("primary", detail="geo_read_error")
    reached = lsn_at_least(serving.applied_lsn, min_lsn) if min_lsn is not None else True
    gates = (
        (covers(serving.coverage, table, is_reference), "coverage_miss"),
        (not templated, "templates_not_replica_served"),
        (reached is not None, "lsn_unknown"),
        (reached, "lsn_behind"),
    )
    failed = next((detail for ok, detail in gates if not ok), None)
    return Route("primary", serving.project_ref, failed) if failed else Route("replica", serving.project_ref)
