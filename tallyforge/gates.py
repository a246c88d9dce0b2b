"""Queries whose row is a response: status, error, coverage, warnings and one value.

Each sends one request through the service over orders in three shards, with something
wrong or decided on the way; the DuckDB equivalent says what must come of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.errors import EngineError, ShardError
from tallyforge.operators.aggregate import SHARD
from tallyforge.plans.executor import Limits, Partials, Table
from tallyforge.plans.geo import Planes, Replica
from tallyforge.plans.planner import DirectoryRow, ShardKey, Template, sampled
from tallyforge.plans.request import parse_request
from tallyforge.service import Service
from tallyforge.sources import cold, rolloff
from tallyforge.workload import JOIN, LEFT_OUT, ONE, ORDER_TYPES, ORDERS_SQL, SPANS, TIER2, TIME, TYPES, dimension, events, facts, orders, request

N = [("count", None, "n")]
HEADERS = {"Authorization": "Bearer t", "apikey": "k"}
RESPONSE = "status int, error string, coverage string, partial boolean, warnings string, value bigint"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def shards(spark: SparkSession, sf_dir: str) -> Table:
    """Orders in a source for each of three spans of days."""
    rows = orders(spark, sf_dir)
    sources = {}
    for name, low, high in SPANS:
        own = rows if low is None else rows.where(F.col("day") >= F.lit(low).cast("timestamp"))
        sources[name] = own if high is None else own.where(F.col("day") < F.lit(high).cast("timestamp"))
    return Table("orders", sources, ORDER_TYPES, None, [DirectoryRow(*span) for span in SPANS], ShardKey("time", "day", TIME))


def _failing(error: Exception) -> Callable:
    def fail():
        raise error

    return fail


def _row(answered: tuple[int, dict]) -> tuple:
    """A response as one row; the value is the sum of ``n`` over its groups."""
    status, body = answered
    if "error" in body:
        return status, body["error"]["code"], None, None, None, None
    found = body["rows"] if "rows" in body else [body["result"]]
    said = " ".join(f"{w['shard']}:{w['code']}" for w in body["warnings"])
    return status, None, body["coverage"], body["partial"], said, sum(r["n"] for r in found)


def _ask(raw: dict, tables: dict, **service) -> tuple[int, dict]:
    return Service(tables, "t", **service).handle("POST", "/query", HEADERS, json.dumps(raw))


def _gate(name: str, run: Callable[[SparkSession, str], tuple[int, dict]], value: str = "NULL", coverage: str | None = "3/3", partial: bool | str = False, warnings: str = "", ctes: str = ORDERS_SQL) -> None:
    """Registers a request that is answered; ``value``, and ``coverage`` and ``warnings`` in brackets, are SQL."""
    _queries[name] = lambda spark, sf_dir: spark.createDataFrame([_row(run(spark, sf_dir))], RESPONSE)
    text = lambda x: x[1:-1] if x.startswith("(") else f"'{x}'"
    _oracles[name] = f"WITH {ctes} SELECT CAST(200 AS INTEGER) AS status, CAST(NULL AS VARCHAR) AS error, {text(coverage)} AS coverage, {partial if isinstance(partial, str) else str(partial).upper()} AS partial, {text(warnings)} AS warnings, CAST(({value}) AS BIGINT) AS value"


def _refused(name: str, run: Callable[[SparkSession, str], tuple[int, dict]], status: int, error: str) -> None:
    _queries[name] = lambda spark, sf_dir: spark.createDataFrame([_row(run(spark, sf_dir))], RESPONSE)
    _oracles[name] = f"SELECT CAST({status} AS INTEGER) AS status, '{error}' AS error, CAST(NULL AS VARCHAR) AS coverage, CAST(NULL AS BOOLEAN) AS partial, CAST(NULL AS VARCHAR) AS warnings, CAST(NULL AS BIGINT) AS value"


def _with(spark: SparkSession, sf_dir: str, sources: dict | None = None, rows: dict | None = None, **table) -> dict[str, Table]:
    """The three shards with other sources, directory rows by shard, or table fields."""
    base = shards(spark, sf_dir)
    directory = [replace(r, **(rows or {}).get(r.shard, {})) for r in base.directory]
    return {"orders": replace(base, sources={**base.sources, **(sources or {})}, **({"directory": directory} | table))}


COUNT = request(N, "orders")
BY_PRIORITY = request(N, "orders", groupBy=["priority"])
SECOND = "day >= TIMESTAMP '1994-01-01' AND day < TIMESTAMP '1996-01-01'"
ALL, BUT_SECOND = "SELECT count(*) FROM o", f"SELECT count(*) FROM o WHERE NOT ({SECOND})"
FLOOR = "<merged>:coverage_floor_unmet"

_gate("gate_served", lambda s, d: _ask(BY_PRIORITY, _with(s, d)), ALL)
_refused("gate_tier_warm", lambda s, d: _ask(COUNT, _with(s, d, directory=())), 404, "tier_warm")
_refused("gate_unknown_table", lambda s, d: _ask(request(N, "nowhere"), {}), 404, "tier_warm")
_gate(
    "gate_fleet_de_listed", lambda s, d: _ask(request(N, "orders", where=[{"col": "day", "op": "lt", "value": "1993-01-01"}], min_shards=1), _with(s, d, directory=[DirectoryRow(*x) for x in SPANS[1:]])),
    "0", "0/0", True, f"<merged>:fleet_de_listed {FLOOR}",
)


def _truncated(spark: SparkSession, sf_dir: str) -> tuple[int, dict]:
    """A hash shard of a tenth of the ids and one of the others, grouped by id: one may have too many groups."""
    frame = orders(spark, sf_dir).withColumn(SHARD, F.when(F.col("id") % 10 == 0, F.lit("few")).otherwise(F.lit("many")))
    table = Table("orders", {}, ORDER_TYPES, frame, [DirectoryRow("few"), DirectoryRow("many")])
    return _ask(request(N, "orders", where=[{"col": "id", "op": "lte", "value": 6000}], groupBy=["id"]), {"orders": table})


_gate(
    "gate_truncated", _truncated, "SELECT coalesce(sum(n), 0) FROM s WHERE n <= 1000", "(concat((SELECT count(*) FROM s WHERE n <= 1000), '/2'))", "(SELECT count(*) FROM s WHERE n > 1000) > 0",
    "((SELECT coalesce(string_agg(shard || ':truncated_groupby', ' ' ORDER BY shard), '') FROM s WHERE n > 1000))",
    ORDERS_SQL + ", s AS (SELECT CASE WHEN id % 10 = 0 THEN 'few' ELSE 'many' END AS shard, count(DISTINCT id) AS n FROM o WHERE id <= 6000 GROUP BY 1)",
)
_gate("gate_max_rows", lambda s, d: _ask(request(N, "orders", groupBy=["priority"], limit=1001), _with(s, d)), "0", "0/3", True, "S1:max_rows_exceeded S2:max_rows_exceeded S3:max_rows_exceeded")
_gate("gate_schema", lambda s, d: _ask(COUNT, _with(s, d, rows={"S2": {"schema_version": 2}})), BUT_SECOND, "2/3", True, "S2:schema_mismatch")
_gate("gate_floor", lambda s, d: _ask(request(N, "orders", min_shards=3), _with(s, d, rows={"S2": {"schema_version": 2}})), BUT_SECOND, "2/3", True, f"S2:schema_mismatch {FLOOR}")
_gate("gate_failures", lambda s, d: _ask(COUNT, _with(s, d, {"S1": _failing(ConnectionError()), "S3": _failing(ShardError(status=503))})), f"SELECT count(*) FROM o WHERE {SECOND}", "1/3", True, "S1:network S3:http_5xx")
_gate("gate_unreadable", lambda s, d: _ask(COUNT, _with(s, d, {"S2": lambda: s.read.parquet(f"{d}/nothing_here.parquet")})), BUT_SECOND, "2/3", True, "S2:excluded")
_gate(
    "gate_unknown_column", lambda s, d: _ask(request(N, "orders", where=[{"col": "amount", "op": "gt", "value": 0}]), _with(s, d, {"S2": shards(s, d).sources["S2"].drop("amount")})),
    f"{BUT_SECOND} AND amount > 0", "2/3", True, "S2:excluded",
)
_refused("gate_fail_fast", lambda s, d: _ask(COUNT | {"coverage_mode": "fail_fast"}, _with(s, d, {"S2": _failing(ShardError(status=429))})), 500, "internal")
_gate("gate_fail_fast_decided", lambda s, d: _ask(COUNT | {"coverage_mode": "fail_fast"}, _with(s, d, rows={"S2": {"schema_version": 2}})), BUT_SECOND, "2/3", True, "S2:schema_mismatch")
_refused("gate_capacity", lambda s, d: _ask(BY_PRIORITY, _with(s, d), limits=Limits(1000, 3)), 422, "capacity_exceeded")
_refused("gate_strict", lambda s, d: _ask(COUNT, _with(s, d), strict_templates=True), 400, "plan_untemplated")
_refused("gate_unforeseen", lambda s, d: _ask(COUNT | {"read_plane": "replica"}, _with(s, d), planes=Planes(_failing(RuntimeError("secret")))), 500, "internal")
_refused("gate_read_only", lambda s, d: _ask(COUNT | {"idempotency_key": "k"}, _with(s, d), config={"read_only": True, "write_epoch": 1}), 503, "read_only_mode")
_refused("gate_min_lsn_off", lambda s, d: _ask(COUNT | {"read_plane": "replica", "min_lsn": "0/1"}, _with(s, d)), 400, "malformed")


def _replica(asked: dict, applied: str, **row) -> Callable[[SparkSession, str], tuple[int, dict]]:
    """The replica holds the even ids alone, so its answers show."""
    planes = Planes(lambda: "spread", lambda: [Replica("r", applied_lsn=applied, **row)])
    return lambda s, d: _ask(COUNT | {"read_plane": "replica"} | asked, _with(s, d, replica=orders(s, d).where("id % 2 = 0")), planes=planes, read_your_writes=True)


_gate("gate_replica", _replica({"min_lsn": "0/9"}, "0/A", coverage=["orders"]), "SELECT count(*) FROM o WHERE id % 2 = 0", "1/1")
_gate("gate_replica_behind", _replica({"min_lsn": "1/0"}, "0/A", coverage=["orders"]), ALL, warnings="r:geo_fallback_primary")
_gate("gate_replica_misses", _replica({}, "0/A", coverage=["parts"]), ALL, warnings="r:geo_fallback_primary")
_gate("gate_override", lambda s, d: _ask(COUNT, _with(s, d), planes=Planes(own="S2"), config={"primary_override": "S2"}), f"SELECT count(*) FROM o WHERE {SECOND}", "1/1", warnings="S2:geo_fallback_primary")
_gate("gate_override_remote", lambda s, d: _ask(COUNT, _with(s, d), planes=Planes(own="S2"), config={"primary_override": "S3"}), "SELECT count(*) FROM o WHERE day >= TIMESTAMP '1996-01-01'", "1/1")
_gate("gate_estimate", lambda s, d: _ask(BY_PRIORITY, _with(s, d, rows={x[0]: {"row_estimate": 1} for x in SPANS})), ALL, warnings="<merged>:row_estimate_mismatch")


def _partial(spark: SparkSession, n: str, **more) -> Partials:
    return Partials(spark.sql(f"SELECT CAST({n} AS bigint) AS n"), **more)


TEMPLATED = [Template("count", "orders", "scalar", frozenset({"count"}), digest="c"), Template("sum", "orders", "scalar", frozenset({"sum"}), digest="s"), Template("rows", "orders", "rows", frozenset({"count"}), digest="r")]
_gate("gate_partials", lambda s, d: _ask(COUNT, _with(s, d, {"S2": _partial(s, "7", template="c")}, templates=TEMPLATED)), f"SELECT count(*) + 7 FROM o WHERE NOT ({SECOND})")
_gate("gate_lying_partials", lambda s, d: _ask(COUNT, _with(s, d, {"S2": _partial(s, "-7")})), BUT_SECOND, "2/3", True, "S2:excluded")
_gate("gate_merge_mismatch", lambda s, d: _ask(COUNT, _with(s, d, {"S2": _partial(s, "7", template="s")}, templates=TEMPLATED)), BUT_SECOND, "2/3", True, "S2:merge_mismatch")
_gate(
    "gate_handshake",
    lambda s, d: _ask(BY_PRIORITY | {"qid": next(f"q{i}" for i in range(999) if sampled(f"q{i}"))} | {"query": BY_PRIORITY["query"] | {"limit": 9}}, _with(s, d, templates=TEMPLATED, inventory=lambda shard: [] if shard == "S2" else [{"name": "rows", "table": "orders", "kind": "rows", "merge_ops": ["count"], "digest": "r"}])),
    BUT_SECOND, "2/3", True, "S2:template_missing",
)


def _joined(join: dict, dims: list[DirectoryRow] | None = None) -> Callable[[SparkSession, str], tuple[int, dict]]:
    """The dimension join under other bindings or placements of the dimension."""
    def run(spark: SparkSession, sf_dir: str) -> tuple[int, dict]:
        placed = [DirectoryRow("all", is_reference=True)] if dims is None else dims
        dim = Table("wh_probe_dim", {}, {}, dimension(spark, sf_dir), placed)
        fact = Table("wh_probe_agg", {}, TYPES, facts(spark, sf_dir), ONE)
        return _ask(request([("sum", "sparse", "x"), *N], groupBy=["region"], join=join), {"wh_probe_agg": fact, "wh_probe_dim": dim, "other_dim": dim}, strict_templates=True)

    return run


JOINED_SQL = "SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey <> "
_gate("gate_join", _joined(JOIN), f"{JOINED_SQL}{LEFT_OUT}", "1/1")
_gate("gate_join_tier2", _joined(TIER2), f"{JOINED_SQL}{LEFT_OUT} AND n_nationkey % 3 = 1", "1/1")
_refused("gate_join_template", _joined(JOIN | {"table": "other_dim"}), 400, "join_template_required")
_refused("gate_join_key", _joined(JOIN | {"on": {"left": "region", "right": "tier"}}), 400, "join_key_mismatch")
_refused("gate_join_no_reference", _joined(JOIN, [DirectoryRow("all")]), 400, "join_not_colocated")
_refused("gate_join_elsewhere", _joined(JOIN, [DirectoryRow("other", is_reference=True)]), 400, "join_not_colocated")
_refused("gate_join_twice", _joined(JOIN, [DirectoryRow("all", is_reference=True)] * 2), 400, "join_not_colocated")


def _snapshot(tampered: bool) -> Callable[[SparkSession, str], tuple[int, dict]]:
    """A second request sends the first's snapshot back, while the directory lists two shards; a valid one is used in its place."""
    def run(spark: SparkSession, sf_dir: str) -> tuple[int, dict]:
        listed = [[{"logical_name": "orders", **{k: getattr(r, k) for k in ("shard", "key_min", "key_max")}} for r in shards(spark, sf_dir).directory]]
        service = Service(_with(spark, sf_dir), "t", lambda: 5, directory=lambda: (5, listed[-1]), snapshot_key="key")
        _, first = service.handle("POST", "/query", HEADERS, json.dumps(COUNT))
        listed.append([r for r in listed[0] if r["shard"] != "S2"])
        token = first["directory_snapshot"]
        return service.handle("POST", "/query", HEADERS, json.dumps(COUNT | {"directory_snapshot": token[:-8] + "AAAAAAA=" if tampered else token}))

    return run


_gate("gate_snapshot", _snapshot(False), ALL)
_gate("gate_snapshot_tampered", _snapshot(True), BUT_SECOND, "2/2")

# Requests that the grammar refuses, each with what is wrong.
_ONE = {"select": [{"op": "count"}]}
REFUSED = {
    "bare column": {"select": [{"col": "amount"}]}, "unknown aggregate": {"select": [{"op": "median", "col": "amount"}]}, "no identifier": {"select": [{"op": "sum", "col": "a b"}]},
    "or": _ONE | {"where": [{"or": []}]}, "in list": _ONE | {"where": [{"col": "id", "op": "in", "value": [1]}]}, "like": _ONE | {"where": [{"col": "id", "op": "like", "value": "x"}]},
    "is a number": _ONE | {"where": [{"col": "id", "op": "is", "value": 1}]}, "one bound": _ONE | {"where": [{"col": "id", "op": "between", "value": [1]}]}, "having": _ONE | {"having": {}},
    "order by": _ONE | {"orderBy": ["id"]}, "offset": _ONE | {"offset": 1}, "distinct": _ONE | {"distinct": True}, "negative limit": _ONE | {"limit": -1}, "two limits": _ONE | {"limit": 1, "fetch_rows": 1},
    "no rows to fetch": _ONE | {"fetch_rows": 0}, "no floor": _ONE | {"min_shards": 0}, "left join": _ONE | {"join": {"table": "d", "type": "left", "on": {"left": "a", "right": "b"}}},
    "self join": _ONE | {"join": {"table": "orders", "type": "inner", "on": {"left": "a", "right": "b"}}}, "other variant": _ONE | {"join": {"table": "d", "type": "inner", "on": {"left": "a", "right": "b"}, "variant": "tier3"}},
    "rank without an aggregate": _ONE | {"rank_by": {"direction": "asc"}}, "rank direction": _ONE | {"rank_by": {"agg": "n", "direction": "up"}}, "empty select": {"select": []},
}


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for case, query in REFUSED.items():
        try:
            parse_request({"v": 1, "qid": "q", "table": "orders", "query": query})
            rows.append((case, 200, None))
        except EngineError as error:
            rows.append((case, error.status, error.code))
    return spark.createDataFrame(rows, "case string, status int, error string").withColumnRenamed("case", "refused")


_queries["gate_grammar"] = _refusals
_oracles["gate_grammar"] = f"SELECT refused, CAST(400 AS INTEGER) AS status, 'malformed' AS error FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in REFUSED)}) v(refused)"


def _finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first days of events entered as cold objects, the second of them twice, and one that overlaps refused."""
    source = events(spark, sf_dir)
    days = cold.source_state(source).orderBy("day").limit(3).collect()
    objects, places, refused = [], [rolloff.Serving("s", "t", "p", bytes_used=99)], 0
    path = lambda low, high: f"public.facts_blocks[{low},{high})"
    reports = [rolloff.ColdObject("t", "p", path(a["day"], b["day"]), 10, a["n_rows"], a["checksum"]) for a, b in zip(days, days[1:])]
    reports += [reports[1], rolloff.ColdObject("t", "p", path(days[0]["day"], days[2]["day"]), 10, 1, "0" * 32)]
    for report in reports:
        try:
            objects, places, _ = rolloff.finalize(report, False, objects, places, {"t": 4})
        except rolloff.RollOffError:
            refused += 1
    rows = [(o.object_path, o.row_count, o.checksum, o.state, o.schema_version, places[0].bytes_used, refused) for o in objects]
    return spark.createDataFrame(rows, "object_path string, row_count bigint, checksum string, state string, schema_version int, bytes_used int, refused int")


_queries["rolloff_finalize"] = _finalized
_oracles["rolloff_finalize"] = """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS row_count, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS checksum FROM events GROUP BY 1),
n AS (SELECT *, lead(day) OVER (ORDER BY day) AS after, row_number() OVER (ORDER BY day) AS i FROM d)
SELECT concat('public.facts_blocks[', day, ',', after, ')') AS object_path, row_count, checksum, 'promoted' AS state, CAST(4 AS INTEGER) AS schema_version, CAST(0 AS INTEGER) AS bytes_used, CAST(1 AS INTEGER) AS refused FROM n WHERE i <= 2"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to ``f(spark, sf_dir) -> DataFrame``."""
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL over the same tables."""
    return dict(_oracles)
