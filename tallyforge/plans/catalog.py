"""The routing catalogue as DataFrames: directory view, roll-off candidates, invariants, version."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.join import overlapping
from tallyforge.plans.planner import DirectoryRow

# How long a health stamp counts, and the fill at which a shard rolls off.
FRESH_SECONDS = 90
ROLL_OFF_SHARE, USABLE_BYTES = "0.80", 450_000_000
HEALTHY = "ACTIVE_HEALTHY"
MAX_DIRECTORY_ROWS = 1000
#: Placement columns whose change moves the directory version; statistics do not.
ROUTING_COLUMNS = ("state", "key_min", "key_max", "hash_slot", "schema_version")


def _placed(tables: DataFrame, placements: DataFrame, projects: DataFrame) -> DataFrame:
    t, p, pr = tables.alias("t"), placements.alias("p"), projects.alias("pr")
    return t.join(p, F.col("p.table_id") == F.col("t.id")).join(pr, F.col("pr.id") == F.col("p.project_id"))


def _live(now: Column) -> Column:
    fresh = F.col("p.last_health_at") > now - F.expr(f"INTERVAL {FRESH_SECONDS} SECONDS")
    return (F.col("pr.status") == HEALTHY) & (F.col("p.schema_version") == F.col("t.schema_version")) & fresh


def directory(tables: DataFrame, placements: DataFrame, projects: DataFrame, now: Column | None = None) -> DataFrame:
    """Placements that queries may use: serving or draining, healthy, fresh and of the table's schema."""
    now = F.current_timestamp() if now is None else now
    live = _placed(tables, placements, projects).where(F.col("p.state").isin("serving", "draining") & _live(now))
    return live.select("t.logical_name", F.col("pr.ref").alias("shard"), "p.key_min", "p.key_max", "p.hash_slot", "p.state", "p.schema_version", "p.row_estimate", "t.is_reference", F.col("pr.status").alias("platform_status"), "p.last_health_at")


def roll_off_candidates(tables: DataFrame, placements: DataFrame, projects: DataFrame, now: Column | None = None, share: str = ROLL_OFF_SHARE, usable: int = USABLE_BYTES) -> DataFrame:
    """Serving placements past the mark, on projects where nothing is being moved."""
    now = F.current_timestamp() if now is None else now
    threshold = (F.lit(share).cast("decimal(5,4)") * F.lit(usable)).cast("bigint")
    busy = placements.where(F.col("state").isin("copying", "draining", "loading")).select("project_id").distinct()
    full = _placed(tables, placements, projects).where((F.col("p.state") == "serving") & _live(now) & (F.col("p.bytes_used") >= threshold))
    rows = full.select("t.logical_name", F.col("p.id").alias("placement_id"), F.col("p.project_id").alias("project_id"), F.col("pr.ref").alias("shard"), "p.bytes_used")
    return rows.join(busy, "project_id", "left_anti")


def broken_invariants(tables: DataFrame, placements: DataFrame) -> DataFrame:
    """Spans with more than one live placement, and reference tables with more than one on a project."""
    live = placements.where(F.col("state").isin("serving", "draining")).join(tables.select(F.col("id").alias("table_id"), F.col("is_reference").alias("reference")), "table_id")
    spans = live.where(~F.col("reference")).groupBy("table_id", "key_min", "key_max", "hash_slot").agg(F.count(F.lit(1)).alias("n"))
    copies = live.where("reference").groupBy("table_id", "project_id").agg(F.count(F.lit(1)).alias("n"))
    return spans.where("n > 1").select("table_id", F.lit("span").alias("kind"), "n").unionByName(copies.where("n > 1").select("table_id", F.lit("reference").alias("kind"), "n"))


def span_overlaps(placements: DataFrame) -> DataFrame:
    """Pairs of live placements of a table whose spans overlap, each pair once."""
    live = placements.where(F.col("state").isin("serving", "draining"))
    pairs = overlapping(live, live, "key_min", "key_max", (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.table_id").alias("table_id"), F.col("a.id").alias("first"), F.col("b.id").alias("second"))


def version_steps(before: Mapping[str, Mapping], after: Mapping[str, Mapping], columns: tuple[str, ...] = ROUTING_COLUMNS) -> int:
    """How far the directory version moves from one set of rows (by id) to the next.

    One for each that comes, goes or changes one of the columns: of placements those that
    route, of cold objects their state.
    """
    moved = sum(any(before[k].get(c) != after[k].get(c) for c in columns) for k in before.keys() & after.keys())
    return moved + len(before.keys() ^ after.keys())


def stamp_health(placements: Mapping[str, Mapping], shards: Mapping[str, str], responded: set[str], now: datetime) -> dict[str, dict]:
    """Placements with ``last_health_at`` renewed for the shards that answered; the version stays."""
    return {k: dict(p, last_health_at=now) if shards.get(k) in responded else dict(p) for k, p in placements.items()}


def read_directory(view: DataFrame, table: str) -> list[dict]:
    """A table's directory rows in one read; more than the bound is an error, not a cut."""
    rows = view.where(F.col("logical_name") == table).limit(MAX_DIRECTORY_ROWS + 1).collect()
    if len(rows) > MAX_DIRECTORY_ROWS:
        raise ValueError("the directory has too many rows for one table")
    return [r.asDict() for r in rows]


#: Columns of a directory row that a planner reads.
PLANNED = ("shard", "key_min", "key_max", "hash_slot", "state", "schema_version", "row_estimate", "is_reference", "platform_status", "last_health_at")


def directory_rows(rows: Sequence[Mapping], table: str) -> list[DirectoryRow]:
    """A table's placements among the directory's rows, which must say whose they are."""
    if rows and not any(isinstance(r.get("logical_name"), str) for r in rows):
        raise ValueError("the directory's rows name no table")
    return [DirectoryRow(**{c: r[c] for c in PLANNED if c in r}) for r in rows if r.get("logical_name") == table]


def plain(rows: Sequence[Mapping]) -> list[dict]:
    """Rows as JSON can say them."""
    return [{k: v.isoformat() if isinstance(v, datetime) else v for k, v in r.items()} for r in rows]
