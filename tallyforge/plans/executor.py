"""Execution of a request over a table's shards, with coverage and warnings.

A request is first planned: columns, shards, join gates, the plane that answers,
templates. Then the shards' partial aggregates are computed in one job over one scan
and kept; the same job tells how many partial rows each shard gave and whether they can
be true. Only if that job fails are the shards tried apart, to leave out those that
fail. Coverage and warnings so describe what was read. What is left is merged, ranked
and cut, lazily.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from typing import Any
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.errors import EngineError, ShardError
from tallyforge.functions.canonical import ColumnType
from tallyforge.operators.aggregate import COUNT, SHARD, adapted, doubtful, finish, merge, partials
from tallyforge.operators.join import join_dimension
from tallyforge.operators.rank import order
from tallyforge.plans import templates as registry
from tallyforge.plans.geo import Planes, Route
from tallyforge.plans.planner import (
    LIVE, DirectoryRow, Plan, ShardKey, Template, build_plan, check_handshake, check_join, covers_whole_spans, derive_templates, estimate, plan_ops, sampled, select_shards,
)
from tallyforge.plans.request import Request, parse_request

# Groups that a response may have, rows that a shard may give, shards tried at once, and most.
MAX_GROUPS = 2000
MAX_ROWS = 1000
WINDOW, MOST_WINDOW = 16, 32
#: The shard that warnings on the whole answer name.
MERGED = "<merged>"
#: Exclusions that are decided and not failures, so ``fail_fast`` lets them pass.
DECIDED = frozenset({"schema_mismatch", "template_missing", "max_rows_exceeded"})


@dataclass(frozen=True)
class Limits:
    """Rows that a shard's grouped partial may have, and groups of an answer; None lifts a limit."""

    rows: int | None = MAX_ROWS
    groups: int | None = MAX_GROUPS


@dataclass
class Partials:
    """Partial aggregates that a shard gives in place of rows.

    ``frame`` has a column for each key, one named like each aggregate, and for an average
    ``x`` the columns ``x_sum`` and ``x_count``; others are ignored.
    """

    frame: DataFrame
    template: str | None = None
    truncated: bool = False
    schema_version: int | None = None


@dataclass
class Table:
    """A logical table: its shards' data, directory rows and column types.

    ``sources`` holds a DataFrame or ``Partials`` for each shard; a callable is opened when
    the shard takes part, and may fail without harming the others. Instead, ``frame`` may
    hold all shards with their names in ``__shard``, a partition column where the data are
    written so; then the chosen shards are one filter on one scan. A frame without that
    column is the one shard of the directory. ``replica`` holds the whole table on the
    replica, ``templates`` (None: the registered ones) those that may serve it, and
    ``inventory`` reads the template rows of a shard.
    """

    name: str
    sources: Mapping[str, Any]
    types: Mapping[str, ColumnType]
    frame: DataFrame | None = None
    directory: Sequence[DirectoryRow] = ()
    key: ShardKey = field(default_factory=ShardKey)
    schema_version: int = 1
    replica: Any = None
    templates: Sequence[Template] | None = None
    inventory: Callable[[str], Any] | None = None
    is_reference: bool | None = None


@dataclass
class Answer:
    """The result rows with what is known about them.

    ``rows`` is lazy and reads partials that are kept until ``close``.
    """

    rows: DataFrame
    plan: Plan
    dispatched: list[str]
    responded: list[str]
    warnings: list[dict]
    merged: DataFrame | None = None
    per_shard: list[dict] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)
    latency_ms: int = 0

    @property
    def coverage(self) -> tuple[int, int]:
        return len(self.responded), len(self.dispatched)

    @property
    def ratio(self) -> float:
        return 1.0 if not self.dispatched else len(self.responded) / len(self.dispatched)

    @property
    def partial(self) -> bool:
        codes = {w["code"] for w in self.warnings}
        return len(self.responded) < len(self.dispatched) or bool(codes & {"coverage_floor_unmet", "fleet_de_listed"})

    def close(self) -> None:
        """Lets go of the kept partials."""
        for frame in self.kept:
            frame.unpersist()
        self.kept = []


@dataclass
class _Target:
    """A shard, replica or project that is asked."""

    shard: str
    open: Callable[[], Any]
    row: DirectoryRow | None = None

    @property
    def est_rows(self) -> int:
        return (self.row and estimate(self.row)) or 0


@dataclass
class _Given:
    """What a target gave: its partials, and what the job said of them."""

    target: _Target
    given: Partials | None = None
    rows: int = 0
    counted: int = 0
    doubtful: int = 0
    failure: tuple[str, str] | None = None
    latency_ms: int = 0


def warning(shard: str, code: str, detail: str = "", est_rows: int = 0) -> dict:
    return {"shard": shard, "code": code, "est_rows": est_rows, "retried": False} | ({"detail": detail} if detail else {})


#: Java exceptions that mean a shard was too slow, or not reached.
LATE = ("SocketTimeoutException", "TimeoutException", "InterruptedIOException")
UNREACHED = ("ConnectException", "UnknownHostException", "NoRouteToHostException", "SocketException", "UnknownServiceException")


def _java_causes(error: BaseException) -> list[str]:
    """Simple class names of the Java exception behind an error and of its causes."""
    at, names = getattr(error, "java_exception", None) or getattr(error, "_origin", None), []
    while at is not None and len(names) < 20:
        names.append(at.getClass().getSimpleName())
        at = at.getCause()
    return names


def classify(error: BaseException) -> tuple[str, str]:
    """A warning code and detail for a shard that failed, by status, code or kind of error, never by its message."""
    status, code = getattr(error, "status", None), getattr(error, "code", None)
    if status in (402, 429):
        return f"http_{status}", ""
    if isinstance(status, int) and 500 <= status <= 599:
        return "http_5xx", ""
    if code in ("WH400", "WH401"):
        return "template_missing", code
    causes = _java_causes(error)
    if isinstance(error, TimeoutError | Late) or code == "timeout" or any(c in LATE for c in causes):
        return "timeout", ""
    if isinstance(error, ConnectionError) or code == "network" or any(c in UNREACHED for c in causes):
        return "network", ""
    if code == "abort_on_oversize":
        return code, ""
    if isinstance(status, int):
        return "excluded", f"http {status}"
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return "excluded", str(code or condition or type(error).__name__)


def _opened(source: Any) -> Any:
    return source() if callable(source) else source


def _targets(table: Table, rows: Sequence[DirectoryRow]) -> list[_Target]:
    """The shards to ask, each with its own source."""
    def source(row: DirectoryRow) -> Callable[[], Any]:
        if table.frame is None:
            return lambda: _opened(table.sources[row.shard])
        return lambda: _of_shards(table, [row.shard])

    return [_Target(r.shard, source(r), r) for r in rows]


def _of_shards(table: Table, shards: Sequence[str]) -> DataFrame:
    """The rows of these shards of a frame, which names no others' as theirs."""
    if SHARD in table.frame.columns:
        return table.frame.where(F.col(SHARD).isin(list(shards)))
    if len(table.directory) != 1:
        raise ValueError("a frame without a column of shards is that of one shard")
    return table.frame.withColumn(SHARD, F.lit(table.directory[0].shard))


def _partials_of(given: Any, plan: Plan, shard: str | None, dim: DataFrame | None) -> Partials:
    """A shard's partials with its name; rows are aggregated and partials adapted to the plan."""
    if isinstance(given, Partials):
        frame = adapted(given.frame, plan).withColumn(SHARD, F.lit(shard))
        return Partials(frame, given.template, given.truncated, given.schema_version)
    rows = given if shard is None else given.withColumn(SHARD, F.lit(shard))
    if plan.join:
        # Each shard holds the whole dimension; one copy joins all shards' rows.
        rows = join_dimension(rows, dim, plan.join)
    return Partials(partials(rows, plan, by_shard=True))


def _bare_count(plan: Plan) -> str | None:
    """The partial column of the plan's first count of all rows."""
    return next((f"__{COUNT}{i}" for i, (a, _) in enumerate(plan.aggregates.values()) if (a.op, a.col) == ("count", None)), None)


def _said(frame: DataFrame, plan: Plan) -> dict[str, tuple[int, int, int]]:
    """By shard: partial rows, rows that they count, and partial rows that cannot be true. A row for each shard reaches the driver."""
    bare = _bare_count(plan)
    counted = F.sum(bare) if bare else F.lit(0)
    said = frame.groupBy(SHARD).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(counted, F.lit(0)).alias("counted"), F.count_if(doubtful(plan)).alias("doubtful"))
    return {r[SHARD]: (r["rows"], r["counted"], r["doubtful"]) for r in said.collect()}


def _together(table: Table, targets: Sequence[_Target], plan: Plan, dim: DataFrame | None) -> tuple[list[_Given], list[DataFrame]]:
    """All targets in one job over one plan."""
    began = time.monotonic()
    given: list[Partials] = []
    if table.frame is not None and all(t.row for t in targets):
        one = _partials_of(_of_shards(table, [t.shard for t in targets]), plan, None, dim)
        union, given = one.frame, [one] * len(targets)
    else:
        given = [_partials_of(t.open(), plan, t.shard, dim) for t in targets]
        union = given[0].frame
        for more in given[1:]:
            union = union.unionByName(more.frame)
    union = union.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        said = _said(union, plan)
    except BaseException:
        union.unpersist()
        raise
    took = int((time.monotonic() - began) * 1000)
    return [_Given(t, Partials(union, g.template, g.truncated, g.schema_version), *said.get(t.shard, (0, 0, 0)), latency_ms=took) for t, g in zip(targets, given)], [union]


def _apart(targets: Sequence[_Target], plan: Plan, dim: DataFrame | None, window: int, timeout: float | None) -> tuple[list[_Given], list[DataFrame]]:
    """Each target in a job of its own, some at once; a failure or delay is its own."""
    context = SparkSession.active().sparkContext
    groups = {t.shard: uuid4().hex for t in targets}

    def ask(target: _Target) -> _Given:
        began = time.monotonic()
        frame = None
        context.setJobGroup(groups[target.shard], f"partials of {target.shard}", True)
        try:
            own = _partials_of(target.open(), plan, target.shard, dim)
            frame = own.frame.persist(StorageLevel.MEMORY_AND_DISK)
            said = _said(frame, plan).get(target.shard, (0, 0, 0))
            return _Given(target, Partials(frame, own.template, own.truncated, own.schema_version), *said, latency_ms=int((time.monotonic() - began) * 1000))
        except EngineError:
            raise
        except Exception as error:  # noqa: BLE001  a shard's failure is its own
            if frame is not None:
                frame.unpersist()
            return _Given(target, failure=classify(error), latency_ms=int((time.monotonic() - began) * 1000))

    out, kept = [], []
    with ThreadPoolExecutor(max(1, min(window, MOST_WINDOW))) as pool:
        waiting = [(t, pool.submit(ask, t)) for t in targets]
        for target, future in waiting:
            try:
                one = future.result(timeout)
            except Late as error:
                context.cancelJobGroup(groups[target.shard])
                one = _Given(target, failure=classify(error), latency_ms=int((timeout or 0) * 1000))
            out.append(one)
            if one.given is not None:
                kept.append(one.given.frame)
    return out, kept


def _refusal(one: _Given, plan: Plan, table: Table, templates: Sequence[Template], cap: int | None) -> tuple[str, str, int] | None:
    """Why what a target gave must not be merged: code, detail, estimated rows."""
    if one.failure:
        return (*one.failure, one.target.est_rows)
    given = one.given
    if given.schema_version not in (None, table.schema_version):
        return "schema_mismatch", "", one.target.est_rows
    if plan.grouped and (given.truncated or cap is not None and one.rows > cap):
        return "truncated_groupby", "a grouped partial that was cut would make wrong sums", one.rows
    if given.template is not None:
        claimed = next((t for t in templates if given.template in (t.digest, t.name)), None)
        if claimed is None or not plan_ops(plan) <= claimed.merge_ops:
            return "merge_mismatch", "the template does not merge what the plan needs", one.rows
    return None


def _dimension(tables: Mapping[str, Table], plan: Plan) -> DataFrame | None:
    if plan.join is None:
        return None
    dim = tables[plan.join.table]
    return dim.frame if dim.frame is not None else _opened(next(iter(dim.sources.values())))


def _single(table: Table, route: Route) -> _Target:
    """The one target of a plane other than the placements."""
    def source() -> Any:
        if route.kind == "replica":
            if table.replica is None:
                raise ShardError(status=404)
            return _opened(table.replica)
        if route.target in table.sources:
            return _opened(table.sources[route.target])
        if table.frame is not None and SHARD in table.frame.columns:
            return _of_shards(table, [route.target]).drop(SHARD)
        raise ShardError(status=404)

    return _Target(route.target, source)


def execute(
    raw: dict | Request, tables: Mapping[str, Table], *, limits: Limits | None = None, strict_templates: bool = False, planes: Planes | None = None,
    shard_timeout: float | None = None, window: int = WINDOW, lazy: bool = False,
) -> Answer:
    """Answers a request; see the module for the order of steps.

    ``lazy`` leaves out all that needs a job: the answer is one plan, coverage says what
    was planned, no limit is looked at, and a shard that fails fails the plan.
    ``strict_templates`` refuses plans that no template serves. With ``shard_timeout``
    (seconds), shards are asked apart from the start.
    """
    began = time.monotonic()
    limits, planes = limits or Limits(), planes or Planes()
    request = raw if isinstance(raw, Request) else parse_request(raw)
    table = tables.get(request.table) or Table(request.table, {}, {})
    plan = build_plan(request, {**table.types, **request.types})
    served = registry.manifest() if table.templates is None else list(table.templates)
    derived = derive_templates(plan, served, table.schema_version)
    serving = [r for r in table.directory if r.state in LIVE]
    chosen = select_shards(serving, request.where, table.key)
    if plan.join:
        dim = tables.get(plan.join.table)
        check_join(plan, derived, served, chosen, dim and [r for r in dim.directory])
    wants_replica = request.read_plane == "replica"
    away = None if wants_replica else planes.route(False, request.table, None, False, None)
    if not serving and (away is None or away.kind == "placements"):
        raise EngineError("tier_warm", "no placement serves the table")
    route = planes.route(True, request.table, table.is_reference, bool(derived), request.min_lsn) if wants_replica else away
    on_placements = route.kind in ("placements", "primary")
    warnings = [route.warning] if route.warning else []
    floor = request.min_shards
    if on_placements and not chosen:
        warnings += [warning(MERGED, "fleet_de_listed")] + ([warning(MERGED, "coverage_floor_unmet")] if floor else [])
        return Answer(_nothing(table, plan), plan, [], [], warnings)
    dispatched = [r.shard for r in chosen] if on_placements else [route.target]
    entries: dict[str, dict] = {}

    def left_out(shard: str, code: str, detail: str = "", est_rows: int = 0, latency_ms: int = 0) -> None:
        warnings.append(warning(shard, code, detail, est_rows))
        entries[shard] = {"shard": shard, "ok": False, "latencyMs": latency_ms, "error": code}

    asked: list[DirectoryRow] = []
    cap = None
    if on_placements:
        cap = None if limits.rows is None else min((t.max_rows for t in derived), default=limits.rows)
        refused = request.limit is not None and cap is not None and request.limit > cap
        audit = not refused and table.inventory is not None and derived and request.limit is not None and sampled(request.qid)
        for row in chosen:
            code = "max_rows_exceeded" if refused else "schema_mismatch" if row.schema_version != table.schema_version else None
            if code is None and audit:
                code = check_handshake(derived, _inventory(table, row.shard), table.schema_version, request.limit)
            if code:
                left_out(row.shard, code, est_rows=estimate(row) or 0)
            else:
                asked.append(row)
        if strict_templates and (request.where or not derived):
            raise EngineError("plan_untemplated", "no template serves this plan")
    targets = _targets(table, asked) if on_placements else [_single(table, route)]
    if lazy:
        return _lazy(table, tables, plan, targets, dispatched, warnings, entries)
    given, kept = _gather(table, targets, plan, _dimension(tables, plan), window, shard_timeout)
    good: list[_Given] = []
    for one in given:
        if why := _refusal(one, plan, table, served, cap):
            left_out(one.target.shard, why[0], why[1], why[2], one.latency_ms)
        else:
            good.append(one)
            entries[one.target.shard] = {"shard": one.target.shard, "ok": True, "latencyMs": one.latency_ms, "error": None, "partial_rows": one.rows}
    if request.coverage_mode == "fail_fast" and any(e["error"] not in (None, *DECIDED) for e in entries.values()):
        _free(kept)
        raise EngineError("internal", "fail_fast: a shard failed", [entries[s] for s in dispatched])
    for one in [g for g in good if g.doubtful]:
        good.remove(one)
        left_out(one.target.shard, "excluded", "envelope_invalid: partials that cannot be true", 0, one.latency_ms)
    merged = merge(_of(good), plan) if good else _empty(table, plan)
    if plan.grouped and limits.groups is not None and sum(g.rows for g in good) > limits.groups and merged.limit(limits.groups + 1).count() > limits.groups:
        _free(kept)
        raise EngineError("capacity_exceeded", "the result has too many groups")
    warnings.sort(key=lambda w: w["shard"])
    if on_placements and len(good) == len(asked) and (found := _mismatch(request, plan, good, asked, table.key)):
        warnings.append(found)
    if floor is not None and len(good) < floor:
        warnings.append(warning(MERGED, "coverage_floor_unmet"))
    return Answer(finish(order(merged, plan), plan), plan, dispatched, [g.target.shard for g in good], warnings, merged, [entries[s] for s in dispatched], kept, int((time.monotonic() - began) * 1000))


def _inventory(table: Table, shard: str) -> list[Template]:
    """A shard's templates; none if they cannot be read."""
    try:
        return registry.inventory(table.inventory(shard))
    except Exception:  # noqa: BLE001  an inventory that cannot be read holds nothing
        return []


def _gather(table: Table, targets: Sequence[_Target], plan: Plan, dim: DataFrame | None, window: int, timeout: float | None) -> tuple[list[_Given], list[DataFrame]]:
    if not targets:
        return [], []
    if timeout is None:
        try:
            return _together(table, targets, plan, dim)
        except EngineError:
            raise
        except Exception:  # noqa: BLE001, S110  which shard failed is found below
            pass
    return _apart(targets, plan, dim, window, timeout)


def _of(good: Sequence[_Given]) -> DataFrame:
    """The partials of these targets; those of one job are one frame."""
    frames: dict[int, tuple[DataFrame, list[str]]] = {}
    for one in good:
        frames.setdefault(id(one.given.frame), (one.given.frame, []))[1].append(one.target.shard)
    union = None
    for frame, shards in frames.values():
        own = frame.where(F.col(SHARD).isin(shards))
        union = own if union is None else union.unionByName(own)
    return union


def _free(kept: Sequence[DataFrame]) -> None:
    for frame in kept:
        frame.unpersist()


def _lazy(table: Table, tables: Mapping[str, Table], plan: Plan, targets: Sequence[_Target], dispatched: list[str], warnings: list[dict], entries: dict[str, dict]) -> Answer:
    """The answer as one plan of a partial and a final aggregation."""
    warnings.sort(key=lambda w: w["shard"])
    if not targets:
        return Answer(_nothing(table, plan), plan, dispatched, [], warnings, per_shard=list(entries.values()))
    dim = _dimension(tables, plan)
    if table.frame is not None and all(t.row for t in targets):
        rows = _of_shards(table, [t.shard for t in targets])
    else:
        rows = None
        for t in targets:
            own = t.open()
            rows = own if rows is None else rows.unionByName(own)
    if plan.join:
        rows = join_dimension(rows, dim, plan.join)
    merged = partials(rows, plan)
    return Answer(finish(order(merged, plan), plan), plan, dispatched, [t.shard for t in targets], warnings, merged, list(entries.values()))


def _mismatch(request: Request, plan: Plan, good: Sequence[_Given], asked: Sequence[DirectoryRow], key: ShardKey) -> dict | None:
    """A warning if a count of whole spans differs from what the directory estimates."""
    estimates = [estimate(r) for r in asked]
    if not asked or None in estimates or _bare_count(plan) is None or request.join or request.limit is not None or not covers_whole_spans(asked, request.where, key):
        return None
    return None if sum(estimates) == sum(g.counted for g in good) else warning(MERGED, "row_estimate_mismatch", est_rows=sum(estimates))


def _empty(table: Table, plan: Plan) -> DataFrame:
    """The merged partials of no rows."""
    spark = SparkSession.active()
    types = {c: t for c, t in table.types.items()} | dict(plan.keys) | {a.col: t for a, t in plan.aggregates.values() if a.col}
    empty = spark.createDataFrame([], T.StructType([])).select(*[F.lit(None).cast(t.sql).alias(c) for c, t in types.items()]) if types else spark.range(0)
    return partials(empty.where(F.lit(False)), Plan(plan.table, plan.keys, plan.aggregates))


def _nothing(table: Table, plan: Plan) -> DataFrame:
    """The result over no rows: none for groups, one for a scalar plan."""
    return finish(order(_empty(table, plan), plan), plan)


def collect_groups(answer: Answer, most: int | None = MAX_GROUPS) -> list:
    """The rows on the driver; refuses more groups than a response may have."""
    if most is not None and answer.plan.grouped and answer.merged is not None and answer.merged.limit(most + 1).count() > most:
        raise EngineError("capacity_exceeded", "the result has too many groups")
    return answer.rows.collect()
