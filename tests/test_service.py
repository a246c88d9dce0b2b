"""Templates, the store and the routes."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.errors import EngineError
from tallyforge.functions.canonical import ColumnType
from tallyforge.operators.order import ordered
from tallyforge.plans import templates
from tallyforge.plans.executor import Table, execute
from tallyforge.plans.planner import DirectoryRow
from tallyforge.service import Service
from tallyforge.sources.loader import LoadError
from tallyforge.sources.rolloff import ColdObject, RollOffError
from tallyforge.sources.store import CatalogStore


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, "ab"[i % 2], Decimal(i) if i % 5 else None) for i in range(40)]
    return {"fact": spark.createDataFrame(rows, "id bigint, region string, amount decimal(18,2)"), "dim": spark.createDataFrame([("a", 2), ("c", 2), ("b", 1)], "region string, tier int")}


def test_templates(frames):
    run = lambda name, **p: [tuple(r) for r in templates.call(name, frames, p).rows.collect()]
    assert run("W1", id_min=0, id_max=4) == [("a", Decimal(2), 2), ("b", Decimal(4), 2)]
    assert run("W2") == [(Decimal(1), Decimal(39), 32)] and run("W3", id_max=0) == [(None, 0)]
    assert [r[0] for r in run("W4", limit=3)] == [39, 38, 37]
    assert [r[0] for r in run("W6")] == ["a", "b"] and [r[0] for r in run("W7")] == ["a"] and run("W8")[0][2:] == (16, 20)
    cut = templates.call("W1", frames, {"limit": 1})
    assert cut.rows.count() == 1 and cut.truncated() and not templates.call("W1", frames, {"limit": 2}).truncated()


@pytest.mark.parametrize("params", [{"id_min": "1"}, {"other": 1}, {"limit": -1}, {"limit": True}, [], {"id_min": 10**9000}])
def test_parameters_are_checked(frames, params):
    with pytest.raises((EngineError, ValueError)):
        templates.call("W1", frames, params or [1])


def test_pinned_templates(frames):
    digest = templates.REGISTRY["W2"].digest
    assert templates.call("W2", frames, digest=digest).rows.count() == 1
    for name, pin in (("W2", "0" * 64), ("W9", None)):
        with pytest.raises(EngineError):
            templates.call(name, frames, digest=pin)


def test_digests_follow_the_body_and_what_it_uses(monkeypatch):
    before = {n: s.digest for n, s in templates.REGISTRY.items()}
    assert len(set(before.values())) == 8 and {n: s.digest for n, s in templates.REGISTRY.items()} == before
    shape = templates.REGISTRY["W2"]
    assert replace(shape, build=templates.REGISTRY["W3"].build).digest != shape.digest and replace(shape, max_rows=5).digest != shape.digest

    def _span(rows, params):
        return rows

    monkeypatch.setattr(_span, "__module__", templates.__name__)
    monkeypatch.setattr(templates, "_span", _span)
    after = {n: s.digest for n, s in templates.REGISTRY.items()}
    assert {n for n in before if before[n] != after[n]} == {"W1", "W2", "W3"}


def test_bodies_are_checked_when_registered():
    def collects(tables, params):
        return tables["fact"].limit(len(tables["fact"].collect()))

    def loops(tables, params):
        for _ in params:
            pass
        return tables["fact"]

    def other(frames):
        return frames["fact"]

    def fine(tables, params):
        rows = tables["fact"]
        return rows.agg(F.count("id").alias("n"))

    for build, kind, ops, parameters in ((collects, "scalar", ("count",), {}), (loops, "scalar", ("count",), {}), (other, "scalar", ("count",), {}), (fine, "rows", ("count",), {}), (fine, "scalar", ("median",), {}), (fine, "scalar", (), {}), (fine, "scalar", ("count",), {"x": float}), (fine, "many", ("count",), {})):
        with pytest.raises(ValueError):
            templates.template("T", kind, ops, parameters)(build)
    assert "T" not in templates.REGISTRY and not templates.lint(templates.Shape("T", "scalar", {}, ("count",), (), fine))


def test_order_by_several_keys(spark):
    rows = spark.createDataFrame([(1, "b"), (None, "a"), (1, "a"), (2, None)], "x int, s string")
    assert [tuple(r) for r in ordered(rows, [("x", True, True), ("s", False, False)]).collect()] == [(None, "a"), (2, None), (1, "a"), (1, "b")]


def test_store_moves_its_version_by_routing_alone(tmp_path):
    store = CatalogStore(str(tmp_path))
    place = {"state": "serving", "key_min": None, "bytes_used": 1}
    assert store.version() == 0 and store.write(placements={"a": place}) == 1
    assert store.write(placements={"a": place | {"bytes_used": 5}}) == 1 and store.write(config={"read_only": False}) == 1
    assert store.write(placements={"a": place | {"state": "draining"}}) == 2
    assert store.config("read_only", "nope") == {"read_only": False} and store.is_reference("t") is None
    store.write(replicas={"a": {"state": "serving", "project_ref": "r"}, "b": {"state": "retired"}})
    assert [r.project_ref for r in store.replicas()] == ["r"]
    store.write(replicas={"a": {"state": "serving"}, "b": {"state": "draining"}})
    with pytest.raises(ValueError):
        store.replicas()


NOW = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)


def stocked(tmp_path):
    store = CatalogStore(str(tmp_path))
    table = {"logical_name": "t", "schema_version": 2, "is_reference": False, "shard_key_type": "range"}
    place = {"table_id": "T", "state": "serving", "schema_version": 2, "key_min": None, "key_max": None, "last_health_at": NOW - timedelta(seconds=30), "bytes_used": 7, "row_estimate": 3}
    projects = {"p": {"ref": "S", "status": "ACTIVE_HEALTHY"}, "q": {"ref": "Z", "status": "PAUSED"}}
    store.write(tables={"T": table}, projects=projects, placements={"a": place | {"project_id": "p"}, "b": place | {"project_id": "q"}, "c": place | {"project_id": "p", "state": "loading"}})
    return store


def test_directory_stamps_and_an_exception_that_changes_nothing(tmp_path):
    store = stocked(tmp_path)
    version, rows = store.directory(NOW)
    assert version == 3 and [(r["logical_name"], r["shard"], r["row_estimate"]) for r in rows] == [("t", "S", 3)]
    assert store.directory(NOW + timedelta(seconds=90))[1] == []
    store.stamp(["S"], NOW + timedelta(seconds=80))
    assert store.version() == 3 and len(store.directory(NOW + timedelta(seconds=90))[1]) == 1
    with pytest.raises(RuntimeError), store.transaction() as state:
        state["placements"] = {}
        raise RuntimeError
    assert len(store.read()["placements"]) == 3


def test_stored_ledger_and_cold_objects(tmp_path):
    store = stocked(tmp_path)
    with store.ledger() as book:
        book.ensure_job("j", "T", 2)
        book.ensure_partitions("j", [("c", "1")])
        book.lease("j", "c", "1", NOW)
    with CatalogStore(str(tmp_path)).ledger() as book:
        assert book.lease("j", "c", "1", NOW)["reason"] == "lease_held" and len(book.resumable("j", NOW + timedelta(minutes=11))) == 1
        book.loaded("j", "c", "1", 4, "f" * 32)
        book.verify("j", "c", "1", "f" * 32)
    with pytest.raises(LoadError), store.ledger() as book:
        book.finalize("j", NOW)  # its span and a serving one overlap
    store.write(placements=store.read()["placements"] | {"a": store.read()["placements"]["a"] | {"key_max": 5}, "b": store.read()["placements"]["b"] | {"key_max": 5}, "c": store.read()["placements"]["c"] | {"key_min": 5}})
    before = store.version()
    with store.ledger() as book:
        assert book.finalize("j", NOW)["placements_flipped"] == 1
    assert store.read()["placements"]["c"]["state"] == "serving" and store.version() == before + 1
    day = ColdObject("T", "q", "public.facts_blocks[2026-01-01,2026-01-02)", 10, 5, "a" * 32, ts=("x", "y"))
    assert store.enter_cold(day, False, 1) == {"placement_id": "b", "superseded": False} and store.enter_cold(day, False)["superseded"]
    assert store.read()["placements"]["b"]["bytes_used"] == 0 and store.version() == before + 2
    with pytest.raises(RollOffError):
        store.enter_cold(day, True)
    assert len(store.read()["cold"]) == 1


def test_answers_stamp_their_shards_and_errors_know_the_version(spark, tmp_path):
    store, stamped = stocked(tmp_path), []
    rows = spark.createDataFrame([("a", 1)], "g string, x bigint")
    table = Table("t", {"S": rows}, {"x": ColumnType("int8")}, schema_version=2)
    body = {"v": 1, "qid": "q", "table": "t", "query": {"select": [{"op": "sum", "col": "x", "alias": "s"}]}}
    key = {"Authorization": "Bearer k", "apikey": "k"}
    for stamp in (stamped.append, lambda shards: 1 / 0):
        service = Service({"t": table}, "k", store.version, directory=lambda: store.directory(NOW), stamp=stamp)
        status, got = service.handle("POST", "/query", key, json.dumps(body))
        assert status == 200 and got["result"] == {"s": 1} and got["directory_version"] == 3 and [e["shard"] for e in got["perShard"]] == ["S"]
    assert stamped == [["S"]]
    status, got = service.handle("POST", "/query", key, json.dumps(body | {"table": "u", "column_types": {"x": "int8"}}))
    assert status == 404 and got["directory_version"] == 3
    service.directory = lambda: (3, [{"shard": "S"}])
    assert service.handle("POST", "/query", key, json.dumps(body))[0] == 500


def test_routes(spark):
    rows = spark.createDataFrame([("a", 1)], "g string, x bigint")
    service = Service({"t": Table("t", {"S": rows}, {"g": ColumnType("text"), "x": ColumnType("int8")}, None, [DirectoryRow("S")])}, "secret", lambda: 4, {"read_only": True})
    key = {"Authorization": "Bearer secret", "apikey": "k"}
    body = {"v": 1, "qid": "q7", "table": "t", "query": {"select": [{"op": "sum", "col": "x", "alias": "s"}]}}
    assert service.handle("OPTIONS", "/query", {})[0] == 204 and service.handle("GET", "/health/", {})[1]["directory_version"] == 4
    status, got = service.handle("POST", "/query/", key, json.dumps(body))
    assert status == 200 and got["result"] == {"s": 1} and got["qid"] == "q7"
    assert service.handle("POST", "/query", key, json.dumps(body | {"idempotency_key": "k"}))[0] == 503
    assert service.handle("POST", "/query", key, "{")[0] == 400 and service.handle("GET", "/query", key)[0] == 400
    for headers, kind in (({}, "missing_bearer"), ({"Authorization": "Bearer x", "apikey": "k"}, "invalid_token"), ({"Authorization": "Bearer secret"}, "bad_apikey")):
        status, got = service.handle("POST", "/query", headers, json.dumps(body))
        assert status == 401 and got["error"]["auth_kind"] == kind
    assert Service({}, None).handle("POST", "/query", key)[0] == 500


def test_failures_are_classified(spark):
    class Refused(Exception):
        status = 429

    def shut():
        raise Refused("no")

    table = Table("t", {"S": shut}, {"x": ColumnType("int8")}, None, [DirectoryRow("S")])
    answer = execute({"v": 1, "qid": "q", "table": "t", "query": {"select": [{"op": "count"}]}}, {"t": table})
    assert [w["code"] for w in answer.warnings] == ["http_429"] and answer.rows.select(F.col("count(*)")).first()[0] == 0
