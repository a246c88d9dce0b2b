"""Cold tier, ledger, roll-off, catalogue, gates and snapshots."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta, timezone

import pytest

from tallyforge.errors import EngineError
from tallyforge.functions import snapshot
from tallyforge.functions.lsn import lsn_at_least
from tallyforge.plans import catalog, geo
from tallyforge.sources import cold, rolloff
from tallyforge.sources.loader import Ledger, LoadError, LoadTable, Placement

NOW = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)


def events(spark, n=2500):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [(i, datetime(2026, 1, 1 + i % 2, i % 24), i % 7, "m", i / 4) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, ts timestamp, device_id int, metric string, value double")


def test_blocks_hold_a_thousand_rows_and_come_back(spark):
    source = events(spark)
    blocks = cold.pack(source)
    sizes = [(str(r["day"]), r["chunk"], r["n_rows"]) for r in blocks.orderBy("day", "chunk").collect()]
    assert sizes == [("2026-01-01", 1, 1000), ("2026-01-01", 2, 250), ("2026-01-02", 1, 1000), ("2026-01-02", 2, 250)]
    back = cold.unpack(blocks).select(*source.columns)
    assert back.exceptAll(source).count() == 0 and source.exceptAll(back).count() == 0
    assert cold.cold_scan(blocks, None).count() == 0 and cold.cold_scan(blocks, "events", "2026-01-02", "2026-01-03").count() == 1250


def test_roll_off_verifies_and_repeats(spark, tmp_path):
    source = events(spark, 1200)
    ids = ",".join(str(i) for i in range(0, 1200, 2))
    report, left, blocks = cold.roll_off_day(source, cold.pack(source).where("false"), "2026-01-01", str(tmp_path))
    assert report["status"] == "rolled_off" and report["checksum"] == hashlib.md5(ids.encode()).hexdigest() and report["n_rows"] == 600
    assert left.count() == 600
    again, _, _ = cold.roll_off_day(left, blocks, "2026-01-01", str(tmp_path))
    assert again["status"] == "already_done" and again["checksum"] == report["checksum"] and again["from_blocks"]
    assert cold.roll_off_day(left, blocks, "2026-05-01", str(tmp_path))[0]["status"] == "empty"
    with pytest.raises(cold.SealError):
        cold.verify_day(blocks, "2026-01-01", "0" * 32)
    with pytest.raises(cold.SealError):
        cold.verify_day(blocks, "2026-01-09", report["checksum"])


def test_pack_keeps_rows_without_id_or_time(spark):
    day = datetime(2026, 1, 1)
    rows = [(1, day, 1, "m", 1.0), (None, day, 1, "m", 2.0), (3, None, 1, "m", 3.0), (None, None, 1, "m", 4.0)]
    source = spark.createDataFrame(rows, "id bigint, ts timestamp, device_id int, metric string, value double")
    back = cold.unpack(cold.pack(source)).select(*source.columns)
    assert back.exceptAll(source).count() == 0 and source.exceptAll(back).count() == 0
    with pytest.raises(cold.SealError):
        cold.blocks_checksum(cold.pack(source))


def test_roll_off_keeps_what_came_late_and_stops_for_it(spark, tmp_path, monkeypatch):
    source = events(spark, 100)
    blocks = cold.pack(source.where("id < 90"))
    left = cold.remaining(source, blocks, "2026-01-01")
    assert sorted(r["id"] for r in left.collect()) == sorted([i for i in range(100) if i % 2 or i >= 90])
    path = tmp_path / "events"
    source.where("id != 98").coalesce(1).write.parquet(str(path))
    read = spark.read.parquet(str(path))
    pack = cold.pack

    def late(rows):
        """One more event is written between the look at the source and the packing."""
        source.where("id = 98").coalesce(1).write.mode("append").parquet(str(path))
        return pack(spark.read.parquet(str(path)).where("to_date(ts) = '2026-01-01'"))

    monkeypatch.setattr(cold, "pack", late)
    with pytest.raises(cold.SealError):
        cold.roll_off_day(read, blocks.where("false"), "2026-01-01", str(tmp_path / "staging"))


def test_checksums_of_days_in_one_task(spark):
    source = events(spark, 1300)
    state = {str(r["day"]): r["checksum"] for r in cold.source_state(source.coalesce(1)).collect()}
    assert state == {f"2026-01-0{d + 1}": hashlib.md5(",".join(str(i) for i in range(d, 1300, 2)).encode()).hexdigest() for d in (0, 1)}


def ledger(kind="range"):
    places = {"a": Placement("a", "t", 0, 10), "b": Placement("b", "t", 9, 20), "c": Placement("c", "t", 10, 20), "x": Placement("x", "other")}
    return Ledger({"t": LoadTable("t", 2, kind), "other": LoadTable("other", 1)}, places)


def run_job(book, placements):
    book.ensure_job("j", "t", 2)
    book.ensure_partitions("j", [(p, "1") for p in placements])
    for p in placements:
        book.lease("j", p, "1", NOW)
        book.loaded("j", p, "1", 5, "f" * 32)
        book.verify("j", p, "1", "f" * 32)
    return book.finalize("j", NOW)


def test_ledger_runs_a_job():
    book = ledger()
    assert run_job(book, ["a", "c"])["placements_flipped"] == 2
    assert book.placements["a"].state == "serving" and book.finalize("j", NOW)["placements_flipped"] == 0
    assert book.verify("j", "a", "1", "f" * 32)["idempotent"]
    assert book.ensure_partitions("j", [("a", "1"), ("x", "1"), ("b", "2")])["inserted"] == 1


def test_ledger_refuses():
    with pytest.raises(LoadError):
        run_job(ledger(), ["a", "b"])
    book = ledger()
    with pytest.raises(LoadError):
        book.ensure_job("j", "t", 1)
    book.ensure_job("j", "t", 2)
    book.ensure_partitions("j", [("a", "1")])
    assert book.lease("j", "a", "1", NOW)["attempts"] == 1
    assert book.lease("j", "a", "1", NOW + timedelta(minutes=9))["reason"] == "lease_held"
    assert book.resumable("j", NOW) == [] and len(book.resumable("j", NOW + timedelta(minutes=11))) == 1
    assert book.lease("j", "a", "1", NOW + timedelta(minutes=11))["attempts"] == 2
    assert book.verify("j", "a", "1", "x")["reason"] == "not_loaded"
    book.loaded("j", "a", "1", 1, "y")
    with pytest.raises(LoadError):
        book.verify("j", "a", "1", "x")
    with pytest.raises(LoadError):
        book.finalize("j", NOW)


def cold_object(days, project="p", **more):
    return rolloff.ColdObject("t", project, f"public.facts_blocks[{days})", 10, 5, "a" * 32, **more)


def test_roll_off_enters_the_catalogue():
    places = [rolloff.Serving("s1", "t", "p", bytes_used=99)]
    first = cold_object("2026-01-01,2026-01-02")
    objects, moved, done = rolloff.finalize(first, False, [], places, {"t": 3})
    assert objects[0].schema_version == 3 and moved[0].bytes_used == 0 and not done["superseded"]
    assert rolloff.finalize(first, False, objects, places, {"t": 3})[2]["superseded"]
    touching = cold_object("2026-01-02,2026-01-03")
    assert len(rolloff.finalize(touching, False, objects, places, {"t": 3})[0]) == 2


@pytest.mark.parametrize("change", [
    {"from_blocks": True}, {"from_blocks": None}, {"report": cold_object("2026-01-02,2026-01-02")}, {"report": cold_object("2026-01-00,2026-01-02")},
    {"report": cold_object("2026-01-01,2026-01-03")}, {"report": cold_object("2026-01-01,2026-01-02", project="q")}, {"placements": []}, {"placement_id": "zz"},
    {"placements": [rolloff.Serving("s1", "t", "p"), rolloff.Serving("s2", "t", "p")]}, {"tables": {}}, {"report": cold_object("2026-02-01,2026-02-02", ts=(1, None))},
    {"report": cold_object("2026-02-01,2026-02-02", key=("5", "5"))}, {"remaining_bytes": -1},
])
def test_roll_off_refusals(change):
    entered = [cold_object("2026-01-01,2026-01-02")]
    named = {"report": cold_object("2026-01-01,2026-01-02"), "from_blocks": False, "cold": entered, "placements": [rolloff.Serving("s1", "t", "p")], "tables": {"t": 1}} | change
    with pytest.raises(rolloff.RollOffError):
        rolloff.finalize(**named)


def test_directory_version_counts_routing_changes():
    one = {"state": "serving", "key_min": None, "bytes_used": 1}
    assert catalog.version_steps({"a": one}, {"a": one | {"bytes_used": 9}}) == 0
    assert catalog.version_steps({"a": one}, {"a": one | {"state": "draining"}, "b": one}) == 2
    assert catalog.version_steps({"a": one}, {}) == 1


def test_write_fence():
    open_ = {"read_only": False, "write_epoch": 4}
    assert geo.write_gate(open_) == 4 and geo.write_gate(open_, 4, True) == 4
    for config, carried, has in (({"write_epoch": 4}, None, False), ({"read_only": True, "write_epoch": 4}, None, False), ({"read_only": False}, None, False), (open_, 3, True), (open_, 5, True), (open_, "4", True), (open_, None, True)):
        with pytest.raises(EngineError) as caught:
            geo.write_gate(config, carried, has)
        assert caught.value.status == 503
    assert geo.is_write({"idempotency_key": "k"}) and geo.is_write({"query": {"select": [{"op": "insert"}]}})
    assert not geo.is_write({"write_epoch": 4}) and not geo.is_write([])


def test_dispatch_and_replicas():
    assert geo.dispatch(None, "me").kind == "placements" and geo.dispatch("me", "").kind == "placements"
    assert geo.dispatch("me", "me").warning["code"] == "geo_fallback_primary" and geo.dispatch("you", "me").kind == "remote"
    good = geo.Replica("r", coverage=["t"], applied_lsn="0/A")
    route = lambda rows, **more: geo.replica_route("spread", lambda: rows, "t", **more)
    assert route([good], min_lsn="0/9").kind == "replica"
    assert geo.replica_route("colocated", lambda: [good], "t").detail == "mode_colocated"
    assert geo.replica_route("spread", None, "t").detail == "geo_read_error"
    assert route([]).detail == "no_serving_row" and route([geo.Replica("r", "draining")]).detail == "state_draining"
    assert route([geo.Replica("r", coverage=["u"])]).detail == "coverage_miss" and route([geo.Replica("r")], is_reference=True).kind == "replica"
    assert route([good], templated=True).detail == "templates_not_replica_served"
    assert route([good], min_lsn="1/0").detail == "lsn_behind" and route([geo.Replica("r", coverage=["t"])], min_lsn="0/1").detail == "lsn_unknown"


def test_lsn_is_compared_as_numbers():
    assert lsn_at_least("0/A", "0/9") and not lsn_at_least("0/9", "0/A") and lsn_at_least("1/0", "0/FFFFFFFF")
    assert lsn_at_least(" 0/A", "0/1") is None and lsn_at_least(None, "0/1") is None and lsn_at_least("123456789/0", "0/1") is None


def test_snapshots():
    token = snapshot.sign([1], 7, "key", NOW)
    assert snapshot.verify(token, "key", 7, NOW + timedelta(seconds=59)).payload == [1]
    for bad, key, version, at in ((token, "other", 7, NOW), (token, "key", 8, NOW), (token, "key", 7, NOW + timedelta(seconds=61)), (token, "key", 7, NOW - timedelta(seconds=6)), (token + "x", "key", 7, NOW), ("a.b.c", "key", 7, NOW), (None, "key", 7, NOW)):
        assert not snapshot.verify(bad, key, version, at).ok
