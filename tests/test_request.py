"""The grammar: what is taken, what is refused."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tallyforge.errors import EngineError
from tallyforge.functions.canonical import ColumnType, render_timestamp
from tallyforge.plans.planner import build_plan, derive_templates
from tallyforge.plans.request import parse_request
from tallyforge.plans.templates import manifest

TYPES = {"region": ColumnType("text"), "amount": ColumnType("numeric"), "qty": ColumnType("int8"), "price": ColumnType("numeric", 2), "created_at": ColumnType("timestamptz")}
SELECT = [{"op": "sum", "col": "amount", "alias": "s"}, {"op": "count", "alias": "c"}]


def body(**query):
    return {"v": 1, "qid": "q", "table": "orders", "query": {"select": SELECT, **query}}


def refused(raw, code="malformed"):
    with pytest.raises(EngineError) as caught:
        build_plan(parse_request(raw), TYPES)
    assert caught.value.code == code


def test_minimal_request():
    plan = build_plan(parse_request(body()), TYPES)
    assert not plan.grouped and list(plan.aggregates) == ["s", "c"]


def test_default_names():
    raw = body()
    raw["query"]["select"] = [{"op": "avg", "col": "price"}, {"op": "count"}]
    assert list(build_plan(parse_request(raw), TYPES).aggregates) == ["avg(price)", "count(*)"]


@pytest.mark.parametrize("raw", [None, [], {}, body() | {"v": 2}, body() | {"v": True}, body() | {"qid": ""}, body() | {"table": "a b"}, body() | {"query": None}, body() | {"coverage_mode": "all"}, body() | {"directory_snapshot": 3}, body() | {"read_plane": "x"}, body() | {"min_lsn": "0/1"}, body() | {"read_plane": "replica", "min_lsn": "zz"}])
def test_outer_refusals(raw):
    refused(raw)


@pytest.mark.parametrize("query", [
    {"select": []}, {"select": [{"op": "median", "col": "qty"}]}, {"select": [{"op": "sum"}]}, {"select": [{"op": "sum", "col": "region"}]},
    {"select": [{"op": "sum", "col": "nope"}]}, {"select": SELECT + [{"op": "min", "col": "qty", "alias": "s"}]}, {"select": [{"op": "count", "alias": 1}]},
    {"having": {}}, {"orderBy": ["region"]}, {"offset": 1}, {"distinct": True}, {"limit": -1}, {"limit": 1.5}, {"limit": True}, {"fetch_rows": 0},
    {"limit": 1, "fetch_rows": 1}, {"limit": None, "fetch_rows": None}, {"min_shards": 0}, {"min_shards": None}, {"groupBy": "region"}, {"groupBy": ["region", "region"]},
    {"groupBy": ["nope"]}, {"where": [{"col": "qty", "op": "in", "value": [1]}]}, {"where": [{"col": "qty", "op": "eq"}]}, {"where": [{"col": "qty", "op": "between", "value": [1]}]},
    {"where": [{"col": "qty", "op": "is", "value": 1}]}, {"rank_by": {"agg": "s"}}, {"groupBy": ["region"], "rank_by": {"agg": "z"}}, {"groupBy": ["region"], "rank_by": {"agg": "s", "by": 1}},
    {"groupBy": ["region"], "rank_by": {"agg": "s", "direction": "up"}}, {"join": {"table": "orders", "type": "inner", "on": {"left": "a", "right": "a"}}},
    {"join": {"table": "dim", "type": "left", "on": {"left": "a", "right": "a"}}}, {"join": {"table": "dim", "type": "inner", "on": {"left": "a"}}},
    {"join": {"table": "dim", "type": "inner", "on": {"left": "a", "right": "a"}, "using": 1}}, {"join": {"table": "dim", "type": "inner", "on": {"left": "a", "right": "a"}, "variant": "tier3"}},
])
def test_query_refusals(query):
    refused(body(**query))


def test_neutral_clauses_pass():
    raw = body(having=None, orderBy=[], offset=0, distinct=False, where=None, groupBy=None, join=None, rank_by=None, limit=None)
    assert build_plan(parse_request(raw), TYPES).limit is None


def test_min_max_cannot_rank():
    raw = body(groupBy=["region"], rank_by={"agg": "lo"})
    raw["query"]["select"] = [{"op": "min", "col": "qty", "alias": "lo"}]
    refused(raw)


@pytest.mark.parametrize(("kind", "value", "parsed"), [
    ("int8", "42", 42), ("int8", -7, -7), ("int8", 3.0, 3), ("numeric", "12.50", Decimal("12.50")), ("numeric", 5, Decimal("5.00")), ("text", "", ""),
])
def test_values_are_exact(kind, value, parsed):
    assert ColumnType(kind, 2).parse(value) == parsed


@pytest.mark.parametrize(("kind", "value"), [
    ("int8", 2**63), ("int8", 1.5), ("int8", "1e3"), ("int8", True), ("int8", 2.0**60), ("numeric", "1.234"), ("numeric", "1e2"), ("numeric", float("nan")), ("text", 5),
    ("timestamptz", "2026-02-30"), ("timestamptz", "2026-13-01"), ("timestamptz", "2026-01-01T00:00:60Z"), ("timestamptz", "2026-01-01T00:00:00"), ("timestamptz", "2026-01-01T00:00:00.1234567Z"), ("timestamptz", 1.5), ("timestamptz", "2026-01-01T00:00:00+24:00"),
])
def test_lossy_values_are_refused(kind, value):
    with pytest.raises(EngineError):
        ColumnType(kind, 2).parse(value)


@pytest.mark.parametrize("value", ["2026-01-02T03:04:05Z", "2026-01-02 05:04:05+02:00", "2026-01-02T05:04:05+0200", "2026-01-02T05:04:05.000+02", 1767323045000])
def test_times_have_one_form(value):
    assert render_timestamp(ColumnType("timestamptz").parse(value)) == "2026-01-02T03:04:05.000000Z"


def named(select, **query):
    raw = {"v": 1, "qid": "q", "table": "wh_probe_agg", "query": {"select": select, **query}}
    return [t.name for t in derive_templates(build_plan(parse_request(raw), TYPES), manifest())]


def test_templates_follow_from_the_plan():
    grouped = {"groupBy": ["region"]}
    join = {"table": "wh_probe_dim", "type": "inner", "on": {"left": "region", "right": "region"}}
    tier2 = join | {"variant": "tier2"}
    total, rows, mean, least = {"op": "sum", "col": "amount"}, {"op": "count"}, {"op": "avg", "col": "amount"}, {"op": "min", "col": "amount"}
    assert named([total, rows], **grouped) == ["W1"]
    assert named([least]) == ["W2"]
    assert named([mean]) == ["W3"]
    assert named([total, rows], join=join, **grouped) == ["W6"]
    assert named([total], join=tier2, **grouped) == ["W7"]
    assert named([mean, rows], join=tier2, **grouped) == ["W8"]
    assert named([mean], **grouped) == [] and named([total]) == []
