"""Aggregation, shards, joins and ranks against hand-made and randomised data."""

from __future__ import annotations

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyforge.errors import EngineError, ShardError
from tallyforge.functions.canonical import ColumnType
from tallyforge.operators.aggregate import SHARD, finish, merge, partials
from tallyforge.operators.rank import rational_key
from tallyforge.plans.envelope import respond
from tallyforge.plans import templates as registry
from tallyforge.plans.executor import Limits, Partials, Table, collect_groups, execute
from tallyforge.plans.geo import Planes, Replica
from tallyforge.plans.planner import DirectoryRow, ShardKey, Template, build_plan, sampled, select_shards
from tallyforge.plans.request import Predicate, parse_request

INT8, TEXT, TIME = ColumnType("int8"), ColumnType("text"), ColumnType("timestamptz")
TYPES = {"g": TEXT, "x": INT8, "n": ColumnType("numeric", 2)}


def ask(select, table="t", **query):
    entries = [{"op": o, "alias": a} | ({"col": c} if c else {}) for o, c, a in select]
    top = {k: query.pop(k) for k in ("coverage_mode", "read_plane", "min_lsn", "qid", "column_types", "column_scales") if k in query}
    return {"v": 1, "qid": "q", "table": table, "query": {"select": entries, **query}, **top}


def tables(spark, shards, directory=None, **more):
    frames = {s: (rows if callable(rows) else spark.createDataFrame(rows, "g string, x bigint, n decimal(18,2)")) for s, rows in shards.items()}
    return {"t": Table("t", frames, TYPES, None, directory or [DirectoryRow(s) for s in shards], **more)}


def test_average_is_never_a_mean_of_means(spark):
    t = tables(spark, {"A": [("a", 10, None)] * 10, "B": [("a", 100, None)] * 1000})
    body = respond(execute(ask([("avg", "x", "m")]), t), "q")
    assert body["result"] == {"m": {"num": 100100, "den": 1010}} and body["coverage"] == "2/2"


def test_group_keys_keep_null_empty_and_null_text_apart(spark):
    t = tables(spark, {"A": [("eu", 1, None), ("", 1, None), ("null", 1, None), (None, 1, None)], "B": [("", 1, None), ("null", 1, None), (None, 1, None)]})
    rows = respond(execute(ask([("count", None, "c")], groupBy=["g"]), t), "q")["rows"]
    assert rows == [{"g": "", "c": 2}, {"g": "eu", "c": 1}, {"g": "null", "c": 2}, {"g": None, "c": 2}]


def test_minimum_ignores_a_shard_of_nulls(spark):
    t = tables(spark, {"A": [("a", 5, None), ("a", 7, None)], "B": [("a", None, None), ("a", None, None)]})
    assert respond(execute(ask([("min", "x", "m")]), t), "q")["result"] == {"m": 5}


def test_no_rows(spark):
    t = tables(spark, {"A": [], "B": []})
    assert respond(execute(ask([("sum", "x", "s"), ("count", None, "c"), ("avg", "n", "m"), ("max", "n", "hi")]), t), "q")["result"] == {"s": None, "c": 0, "m": None, "hi": None}
    assert respond(execute(ask([("sum", "x", "s")], groupBy=["g"]), t), "q")["rows"] == []


def test_sums_do_not_wrap_and_are_scaled(spark):
    t = tables(spark, {"A": [("a", 2**62, Decimal("613.95"))] * 4})
    assert respond(execute(ask([("sum", "x", "s"), ("sum", "n", "n")]), t), "q")["result"] == {"s": 2**64, "n": 245580}


@pytest.mark.parametrize("seed", range(4))
def test_merging_in_any_order_gives_the_same(spark, seed):
    rng = random.Random(seed)
    shards = {f"S{i}": [(rng.choice(["a", "b", "", "null", None]), rng.choice([None, rng.randint(-25, 75)]), None) for _ in range(rng.randint(0, 40))] for i in range(4)} | {"E": []}
    raw = ask([("sum", "x", "s"), ("count", "x", "c"), ("count", None, "n"), ("min", "x", "lo"), ("max", "x", "hi"), ("avg", "x", "m")], groupBy=["g"])
    plan = build_plan(parse_request(raw), TYPES)
    every = None
    for name, rows in shards.items():
        frame = spark.createDataFrame(rows, "g string, x bigint, n decimal(18,2)").withColumn(SHARD, F.lit(name))
        every = frame if every is None else every.unionByName(frame)
    one = partials(every, plan)
    by_shard = partials(every, plan, by_shard=True)
    some, rest = by_shard.where(F.col(SHARD).isin("S0", "S3")), by_shard.where(~F.col(SHARD).isin("S0", "S3"))
    tree = merge(merge(rest, plan).unionByName(merge(some, plan)), plan)
    expected = {}
    for g, x, _ in (r for rows in shards.values() for r in rows):
        expected.setdefault(g, []).append(x)
    for frame in (one, merge(by_shard, plan), tree):
        got = {r["g"]: r for r in finish(frame, plan).collect()}
        assert got.keys() == expected.keys()
        for g, xs in expected.items():
            known = [x for x in xs if x is not None]
            r = got[g]
            assert (r["s"], r["c"], r["n"], r["lo"], r["hi"]) == (sum(known) if known else None, len(known), len(xs), min(known, default=None), max(known, default=None))
            assert (r["m_num"], r["m_den"]) == ((sum(known), len(known)) if known else (None, None))


def test_rational_key_orders_exactly(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(-(10**e), 10**e), rng.randint(1, 10 ** rng.randint(1, 18))) for e in (5, 15, 30, 37) for _ in range(60)]
    pairs += [(10**37, 2**63 - 1), (10**37 + 1, 2**63 - 1), (1 - 10**38, 1), (10**38 - 1, 1), (10**38 - 1, 2**63 - 1), (1, 2**63 - 1), (1, 2**63 - 2), (0, 5), (1, 3), (2, 6), (-1, 3), (-2, 6)]
    frame = spark.createDataFrame([(Decimal(a), b) for a, b in pairs], "num decimal(38,0), den bigint")
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rational_key(F.col("num"), F.col("den")))])
    rows = frame.select("num", "den", key.alias("key")).collect()
    value = lambda r: Fraction(int(r["num"]), int(r["den"]))
    rows.sort(key=lambda r: tuple(r["key"]))
    for a, b in zip(rows, rows[1:]):
        assert value(a) <= value(b)
        assert (value(a) == value(b)) == (tuple(a["key"]) == tuple(b["key"]))


def test_rank_of_wide_decimals(spark):
    types, whole = {"g": TEXT, "x": ColumnType("numeric", 2)}, "9" * 30
    rows = spark.createDataFrame([("a", Decimal(whole + ".99")), ("b", Decimal(whole + ".98")), ("c", Decimal(f"-{whole}.99")), ("d", None)], "g string, x decimal(38,2)")
    t = {"t": Table("t", {"A": rows}, types, None, [DirectoryRow("A")])}
    assert [r["g"] for r in execute(ask([("avg", "x", "m")], groupBy=["g"], rank_by={"agg": "m"}), t).rows.collect()] == ["a", "b", "c", "d"]


def test_rank_ties_by_key_and_null_last(spark):
    t = tables(spark, {"A": [("b", 2, None), ("a", 2, None), ("c", None, None), ("d", 9, None), (None, 2, None)]})
    for direction, expected in (("desc", ["d", "a", "b", None, "c"]), ("asc", ["a", "b", None, "d", "c"])):
        raw = ask([("avg", "x", "m")], groupBy=["g"], rank_by={"agg": "m", "direction": direction})
        assert [r["g"] for r in execute(raw, t).rows.collect()] == expected


RANGE = [DirectoryRow("S1", "2026-01-01", "2026-02-01"), DirectoryRow("S2", "2026-02-01", "2026-04-01"), DirectoryRow("S3", "2026-04-01", "2026-06-01")]


@pytest.mark.parametrize(("op", "value", "expected"), [
    ("gte", "2026-04-10", ["S3"]), ("gte", "2026-04-01", ["S2", "S3"]), ("eq", "2026-02-15", ["S2"]), ("eq", "2026-04-01", ["S2", "S3"]), ("lte", "2026-02-01", ["S1", "S2"]),
    ("gt", "2026-04-01", ["S2", "S3"]), ("between", ("2026-02-15", "2026-05-15"), ["S2", "S3"]), ("lt", "2025-12-31", []), ("lt", "2026-01-01", ["S1"]), ("neq", "2026-01-01", ["S1", "S2", "S3"]), ("is", None, ["S1", "S2", "S3"]),
])
def test_range_pruning(op, value, expected):
    key = ShardKey("time", "created_at", TIME)
    assert [r.shard for r in select_shards(RANGE, [Predicate("created_at", op, value)], key)] == expected
    assert len(select_shards(RANGE, [Predicate("other", op, value)], key)) == 3


def test_pruning_intersects_and_keeps_the_unreadable():
    key = ShardKey("time", "created_at", TIME)
    window = [Predicate("created_at", "gte", "2026-03-01"), Predicate("created_at", "lt", "2026-05-01")]
    assert [r.shard for r in select_shards(RANGE, window, key)] == ["S2", "S3"]
    odd = [DirectoryRow("X", "soon", None)]
    assert select_shards(odd, window, key) == odd
    with pytest.raises(EngineError):
        select_shards(RANGE, [Predicate("created_at", "between", ("2026-05-01", "2026-03-01"))], key)


def test_hash_pruning():
    rows = [DirectoryRow("S1", hash_slot=0), DirectoryRow("S2", hash_slot=1), DirectoryRow("S3", hash_slot=0)]
    assert [r.shard for r in select_shards(rows, [Predicate("id", "eq", 4)], ShardKey("hash", "id", INT8, lambda v: v % 2))] == ["S1", "S3"]
    assert len(select_shards(rows, [Predicate("id", "gt", 4)], ShardKey("hash", "id", INT8, lambda v: v % 2))) == 3
    assert len(select_shards(rows, [Predicate("id", "eq", 4)], ShardKey("hash", "id", INT8))) == 3


def broken():
    raise ConnectionError("connection refused")


def test_a_failed_shard_is_left_out_and_reported(spark):
    t = tables(spark, {"A": [("a", 1, None)], "B": broken})
    answer = execute(ask([("sum", "x", "s")]), t)
    assert answer.coverage == (1, 2) and answer.partial and [w["code"] for w in answer.warnings] == ["network"]
    assert respond(answer, "q")["result"] == {"s": 1}
    with pytest.raises(EngineError):
        execute(ask([("sum", "x", "s")], coverage_mode="fail_fast"), t)


def test_other_schema_versions_and_the_coverage_floor(spark):
    t = tables(spark, {"A": [("a", 1, None)], "B": [("a", 5, None)]}, [DirectoryRow("A"), DirectoryRow("B", schema_version=2)])
    answer = execute(ask([("sum", "x", "s")], min_shards=2), t)
    assert {w["code"] for w in answer.warnings} == {"schema_mismatch", "coverage_floor_unmet"}
    assert respond(answer, "q")["result"] == {"s": 1}


def codes(answer):
    return [(w["shard"], w["code"]) for w in answer.warnings]


def test_no_shards_and_unknown_tables(spark):
    for served in ({"t": Table("t", {}, TYPES)}, {}, tables(spark, {"A": []}, [DirectoryRow("A", state="retired")])):
        with pytest.raises(EngineError) as caught:
            execute(ask([("count", None, "c")]), served)
        assert (caught.value.code, caught.value.status) == ("tier_warm", 404)
    pruned = tables(spark, {"S1": []}, RANGE[:1], key=ShardKey("time", "created_at", TIME))
    answer = execute(ask([("count", None, "c")], where=[{"col": "created_at", "op": "lt", "value": "2020-01-01"}], min_shards=1), pruned)
    assert answer.ratio == 1 and answer.partial and codes(answer) == [("<merged>", "fleet_de_listed"), ("<merged>", "coverage_floor_unmet")]
    assert respond(answer, "q")["result"] == {"c": 0} and respond(answer, "q")["coverage"] == "0/0"


def test_a_de_listed_shard_of_a_frame_is_not_counted(spark):
    frame = spark.createDataFrame([("S1", 1), ("S2", 2), ("S3", 100)], f"{SHARD} string, x bigint")
    t = {"t": Table("t", {}, TYPES, frame, [DirectoryRow("S1"), DirectoryRow("S2")])}
    for lazy in (False, True):
        assert execute(ask([("sum", "x", "s")]), t, lazy=lazy).rows.first()["s"] == 3
    with pytest.raises(ValueError):
        execute(ask([("sum", "x", "s")]), {"t": Table("t", {}, TYPES, frame.drop(SHARD), [DirectoryRow("S1"), DirectoryRow("S2")])}, lazy=True)


def test_limits(spark):
    t = tables(spark, {"A": [(str(i), i, None) for i in range(30)]})
    assert execute(ask([("sum", "x", "s")], groupBy=["g"], limit=4), t).rows.count() == 4
    over = execute(ask([("sum", "x", "s")], groupBy=["g"], limit=1001), t)
    assert over.coverage == (0, 1) and codes(over) == [("A", "max_rows_exceeded")] and over.rows.count() == 0 and over.per_shard[0]["error"] == "max_rows_exceeded"
    for limits in (Limits(1000, 29), None):
        with pytest.raises(EngineError) as caught:
            collect_groups(execute(ask([("sum", "x", "s")], groupBy=["g"]), t, limits=limits), most=29)
        assert caught.value.status == 422


def test_a_shard_whose_groups_are_cut_is_not_merged(spark):
    t = tables(spark, {"A": [(str(i), 1, None) for i in range(30)], "B": [("0", 5, None)]})
    answer = execute(ask([("sum", "x", "s")], groupBy=["g"]), t, limits=Limits(29))
    assert codes(answer) == [("A", "truncated_groupby")] and answer.warnings[0]["est_rows"] == 30 and answer.coverage == (1, 2)
    assert respond(answer, "q")["rows"] == [{"g": "0", "s": 5}]
    assert execute(ask([("sum", "x", "s")]), t, limits=Limits(1)).coverage == (2, 2)
    with pytest.raises(EngineError):
        execute(ask([("sum", "x", "s")], groupBy=["g"], coverage_mode="fail_fast"), t, limits=Limits(29))


def test_a_shard_that_fails_while_it_is_read(spark, tmp_path):
    for shard in ("A", "B"):
        spark.createDataFrame([("a", 1, None)], "g string, x bigint, n decimal(18,2)").coalesce(1).write.parquet(f"{tmp_path}/{SHARD}={shard}")
    broken = next((tmp_path / f"{SHARD}=B").glob("*.parquet"))
    t = {"t": Table("t", {}, TYPES, spark.read.parquet(str(tmp_path)), [DirectoryRow("A"), DirectoryRow("B", row_estimate=9)])}
    raw = ask([("sum", "x", "s")])
    assert respond(execute(raw, t), "q")["result"] == {"s": 2}
    broken.write_bytes(b"PAR1" + bytes(40) + b"PAR1")
    answer = execute(raw, t)
    body = respond(answer, "q")
    assert body["coverage"] == "1/2" and body["partial"] and body["result"] == {"s": 1} and [(w["shard"], w["code"], w["est_rows"]) for w in body["warnings"]] == [("B", "excluded", 9)]
    assert [(e["shard"], e["ok"], e.get("partial_rows")) for e in body["perShard"]] == [("A", True, 1), ("B", False, None)]
    with pytest.raises(EngineError) as caught:
        execute(ask([("sum", "x", "s")], coverage_mode="fail_fast"), t)
    assert caught.value.code == "internal" and [e["ok"] for e in caught.value.per_shard] == [True, False]


def test_unknown_columns_and_conditions_on_other_types_leave_the_shards_out(spark):
    t = tables(spark, {"A": [("a", 1, None)]})
    for where in ([{"col": "nope", "op": "eq", "value": 1}], [{"col": "x", "op": "is", "value": True}]):
        answer = execute(ask([("count", None, "c")], where=where), t)
        assert codes(answer) == [("A", "excluded")] and respond(answer, "q")["result"] == {"c": 0}


def test_slow_shards(spark):
    def late():
        raise TimeoutError

    t = tables(spark, {"A": [("a", 1, None)], "B": late})
    answer = execute(ask([("sum", "x", "s")]), t, shard_timeout=60)
    assert codes(answer) == [("B", "timeout")] and respond(answer, "q")["result"] == {"s": 1}


@pytest.mark.parametrize(("error", "code"), [
    (ShardError(status=402), "http_402"), (ShardError(status=503), "http_5xx"), (ShardError(status=404), "excluded"), (ShardError(code="WH401"), "template_missing"),
    (ShardError(code="abort_on_oversize"), "abort_on_oversize"), (ConnectionError(), "network"), (ValueError("timeout 429"), "excluded"),
])
def test_failures_by_kind(spark, error, code):
    def fail():
        raise error

    assert codes(execute(ask([("sum", "x", "s")]), tables(spark, {"A": fail}))) == [("A", code)]


def test_partials_of_shards(spark):
    raw = ask([("sum", "x", "s"), ("avg", "x", "m"), ("count", None, "c")], groupBy=["g"])
    columns = "g string, s bigint, m_sum bigint, m_count bigint, c bigint, extra int"
    good = spark.createDataFrame([("a", 3, 3, 2, 2, 0), ("b", None, None, 0, 1, 0)], columns)
    lying = spark.createDataFrame([("a", 3, None, 2, 2, 0)], columns)
    served = lambda given, **more: {"t": Table("t", {"A": Partials(good), "B": given}, TYPES, None, [DirectoryRow("A"), DirectoryRow("B")], templates=[Template("W", "t", "rows", frozenset({"sum", "count", "avg_pair"}), digest="d"), Template("V", "t", "rows", frozenset({"sum"}), digest="e")], **more)}
    twice = respond(execute(raw, served(Partials(good, "d"))), "q")
    assert twice["coverage"] == "2/2" and twice["rows"] == [{"g": "a", "s": 6, "m": {"num": 6, "den": 4}, "c": 4}, {"g": "b", "s": None, "m": None, "c": 2}]
    for given, code in (
        (Partials(lying), "excluded"), (Partials(good.drop("c")), "excluded"), (Partials(good.withColumn("s", F.col("s").cast("double"))), "excluded"), (Partials(good, "e"), "merge_mismatch"),
        (Partials(good, "?"), "merge_mismatch"), (Partials(good, truncated=True), "truncated_groupby"), (Partials(good, schema_version=2), "schema_mismatch"),
    ):
        body = respond(execute(raw, served(given)), "q")
        assert [(w["shard"], w["code"]) for w in body["warnings"]] == [("B", code)] and body["rows"][0]["s"] == 3 and body["coverage"] == "1/2"


def test_count_advisory(spark):
    rows = [("a", 1, None)] * 3
    found = lambda estimates, **query: codes(execute(ask([("count", None, "c")], **query), tables(spark, {s: rows for s in "AB"}, [DirectoryRow(s, row_estimate=e) for s, e in zip("AB", estimates)])))
    assert found((3, 4)) == [("<merged>", "row_estimate_mismatch")] == found((3, 4), groupBy=["g"])
    assert found((3, 3)) == found((3, None)) == found((3, 0)) == found((3, 4), groupBy=["g"], limit=5) == found((3, 4), where=[{"col": "x", "op": "gt", "value": 0}]) == []


def test_count_advisory_under_a_window_round_whole_spans(spark):
    row = lambda day: spark.createDataFrame([(f"2026-{day}",)], "created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    frames = {"S1": row("01-10"), "S2": row("02-10"), "S3": row("04-10")}
    places = [DirectoryRow(r.shard, r.key_min, r.key_max, row_estimate=7) for r in RANGE]
    t = {"t": Table("t", frames, {"created_at": TIME}, None, places, ShardKey("time", "created_at", TIME))}
    found = lambda *where: codes(execute(ask([("count", None, "c")], where=[{"col": "created_at", "op": o, "value": v} for o, v in where]), t))
    assert found(("gte", "2026-01-01"), ("lt", "2026-06-01")) == [("<merged>", "row_estimate_mismatch")] == found(("between", ["2026-01-01", "2026-06-01"]))
    assert found(("gt", "2026-01-01")) == found(("gte", "2026-01-02")) == found(("lt", "2026-05-01")) == found(("neq", "2026-05-01")) == []


def test_planes(spark):
    t = tables(spark, {"A": [("a", 1, None)], "B": [("a", 2, None)]}, replica=spark.createDataFrame([("a", 9, None)], "g string, x bigint, n decimal(18,2)"))
    raw = ask([("sum", "x", "s")], read_plane="replica")
    here = lambda **row: Planes(lambda: "spread", lambda: [Replica("r", **row)])
    won = respond(execute(raw, t, planes=here(coverage=["t"], applied_lsn="0/9")), "q")
    assert (won["coverage"], won["result"], won["warnings"], won["perShard"][0]["shard"]) == ("1/1", {"s": 9}, [], "r")
    for planes, detail, shard in ((None, "mode_colocated", "geo_replica"), (Planes(lambda: "spread"), "geo_read_error", "geo_replica"), (here(coverage=["u"]), "coverage_miss", "r"), (here(state="draining"), "state_draining", "r")):
        body = respond(execute(raw, t, planes=planes), "q")
        assert body["result"] == {"s": 3} and [(w["shard"], w["code"], w["detail"], w["est_rows"]) for w in body["warnings"]] == [(shard, "geo_fallback_primary", detail, 0)] and body["coverage"] == "2/2"
    behind = execute(ask([("sum", "x", "s")], read_plane="replica", min_lsn="0/A"), t, planes=here(coverage=["t"], applied_lsn="0/9"))
    assert behind.warnings[0]["detail"] == "lsn_behind"
    local = respond(execute(ask([("sum", "x", "s")]), t, planes=Planes(override="B", own="B")), "q")
    assert local["result"] == {"s": 2} and local["coverage"] == "1/1" and local["warnings"][0]["detail"] == "geo_promoted_primary_local"
    away = respond(execute(ask([("sum", "x", "s")]), t, planes=Planes(override="elsewhere", own="B")), "q")
    assert away["coverage"] == "0/1" and [w["code"] for w in away["warnings"]] == ["excluded"]
    assert execute(ask([("count", None, "s")], table="u"), t, planes=Planes(override="A", own="A")).coverage == (0, 1)


def test_handshake_of_sampled_requests(spark):
    qid = next(f"q{i}" for i in range(99) if sampled(f"q{i}"))
    own = Template("W", "t", "rows", frozenset({"sum"}), digest="d")
    held = {"name": "W", "table": "t", "kind": "rows", "merge_ops": ["sum"], "digest": "d"}
    for rows, code in (([held], None), ([], "template_missing"), ([held | {"state": "retired"}], "template_missing"), ([held, {"digest": 5}], "template_missing"), ([held | {"schema_version": 2}], "schema_mismatch"), ([held | {"max_rows": 3}], "max_rows_exceeded")):
        t = tables(spark, {"A": [("a", 1, None)]}, templates=[own], inventory=lambda shard, rows=rows: rows)
        for name in (qid, "q" if not sampled("q") else "p"):
            answer = execute(ask([("sum", "x", "s")], groupBy=["g"], limit=4, qid=name, coverage_mode="fail_fast"), t)
            assert codes(answer) == ([("A", code)] if code and name == qid else [])


def test_declared_types_override(spark):
    t = tables(spark, {"A": [("7", 1, None)]})
    raw = ask([("sum", "g", "s")], column_types={"g": "numeric"}, column_scales={"g": 1})
    assert respond(execute(raw, t), "q")["result"] == {"s": 70}
    for bad in ({"column_types": {"g": "float"}}, {"column_types": ["g"]}, {"column_types": {"g": "numeric"}, "column_scales": {"g": 19}}, {"column_types": {"a b": "text"}}):
        with pytest.raises(EngineError) as caught:
            execute(ask([("count", None, "c")], **bad), t)
        assert caught.value.status == 400


def test_join_gates_of_templates(spark):
    dims = [DirectoryRow("A", is_reference=True)]
    dim = Table("wh_probe_dim", {"A": spark.createDataFrame([("a", 2)], "region string, tier int")}, {}, None, dims)
    facts = spark.createDataFrame([("a", 1)], "region string, amount bigint")
    t = {"wh_probe_agg": Table("wh_probe_agg", {"A": facts}, {"region": TEXT, "amount": INT8}, None, [DirectoryRow("A")]), "wh_probe_dim": dim, "other": dim}
    join = {"table": "wh_probe_dim", "type": "inner", "on": {"left": "region", "right": "region"}}
    for op in ("sum", "min"):  # with a template, and with none that has the operation
        run = lambda j, op=op, **more: execute(ask([(op, "amount", "x")], "wh_probe_agg", groupBy=["region"], join=j), t, **more)
        assert respond(run(join), "q")["rows"] == [{"region": "a", "x": 1}]
        for bad, code in ((join | {"table": "other"}, "join_template_required"), (join | {"on": {"left": "region", "right": "tier"}}, "join_key_mismatch")):
            with pytest.raises(EngineError) as caught:
                run(bad)
            assert (caught.value.code, caught.value.status) == (code, 400)
    with pytest.raises(EngineError) as caught:
        run(join, strict_templates=True)
    assert caught.value.code == "plan_untemplated"
    assert [x.name for x in registry.manifest()] == [f"W{i}" for i in range(1, 9)]


def test_join_gates(spark):
    dim = spark.createDataFrame([("a", 2), ("b", 1)], "g string, tier int")
    join = {"table": "d", "type": "inner", "on": {"left": "g", "right": "g"}}
    facts = tables(spark, {"A": [("a", 1, None), ("b", 2, None), ("z", 4, None)]})
    good = facts | {"d": Table("d", {"A": dim}, {"g": TEXT}, None, [DirectoryRow("A", is_reference=True)])}
    raw = ask([("sum", "x", "s")], groupBy=["g"], join=join)
    assert [tuple(r) for r in execute(raw, good).rows.collect()] == [("a", 1), ("b", 2)]
    tier2 = ask([("sum", "x", "s")], groupBy=["g"], join=join | {"variant": "tier2"})
    assert [tuple(r) for r in execute(tier2, good).rows.collect()] == [("a", 1)]
    for rows in ([DirectoryRow("A")], [DirectoryRow("B", is_reference=True)], []):
        with pytest.raises(EngineError) as caught:
            execute(raw, facts | {"d": Table("d", {"A": dim}, {"g": TEXT}, None, rows)})
        assert caught.value.code == "join_not_colocated"


def test_strict_templates(spark):
    with pytest.raises(EngineError) as caught:
        execute(ask([("sum", "x", "s")]), tables(spark, {"A": []}), strict_templates=True)
    assert caught.value.code == "plan_untemplated"
