"""Entering a rolled-off day into the catalogue of cold objects."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date
from typing import Any

# The form of an object path, and of a checksum.
PATH = re.compile(r"public\.facts_blocks\[(\d{4}-\d\d-\d\d),(\d{4}-\d\d-\d\d)\)")
CHECKSUM = re.compile(r"[0-9a-f]{32}")


class RollOffError(Exception):
    """A report that the catalogue refuses."""


@dataclass(frozen=True)
class ColdObject:
    table_id: str
    project_id: str
    object_path: str
    bytes: int
    row_count: int
    checksum: str
    ts: tuple[Any, Any] = (None, None)
    dev: tuple[Any, Any] = (None, None)
    key: tuple[Any, Any] = (None, None)
    schema_version: int = 1
    state: str = "promoted"
    kind: str = "packed_blocks"
    codec: str = "jsonb+lz4"


@dataclass(frozen=True)
class Serving:
    """A placement as roll-off sees it."""

    id: str
    table_id: str
    project_id: str
    state: str = "serving"
    bytes_used: int = 0


def day_range(path: str | None) -> tuple[date, date] | None:
    """The half-open days of an object path; None if it has no such form or is empty."""
    match = PATH.fullmatch(path or "")
    try:
        low, high = (date.fromisoformat(d) for d in match.groups()) if match else (None, None)
    except ValueError:
        return None
    return (low, high) if low and low < high else None


def days_overlap(a: tuple[date, date], b: tuple[date, date]) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def _paired(pair: tuple[Any, Any], what: str, strict: bool) -> None:
    low, high = pair
    if (low is None) != (high is None):
        raise RollOffError(f"{what} bounds come both or not at all")
    if low is not None and (low > high or strict and low == high):
        raise RollOffError(f"{what} bounds must ascend")


def finalize(report: ColdObject, from_blocks: bool | None, cold: Sequence[ColdObject], placements: Sequence[Serving], tables: dict[str, int], remaining_bytes: int | None = None, placement_id: str | None = None) -> tuple[list[ColdObject], list[Serving], dict]:
    """The cold objects and placements after the report, and what was done.

    A report must come from source rows and not from blocks packed earlier, be well
    formed, cover days that no other promoted object of the table covers, and name a
    serving placement; the same path from the same project replaces its object.
    """
    if from_blocks is not False:
        raise RollOffError("only a report on source rows can be entered")
    if not CHECKSUM.fullmatch(report.checksum or ""):
        raise RollOffError("the checksum is not an MD5")
    days = day_range(report.object_path)
    if days is None:
        raise RollOffError("the object path has no ascending day range")
    if None in (report.bytes, report.row_count) or min(report.bytes, report.row_count, remaining_bytes or 0) < 0:
        raise RollOffError("sizes must not be negative")
    for pair, what, strict in ((report.key, "key", True), (report.ts, "ts", False), (report.dev, "dev", False)):
        _paired(pair, what, strict)
    if report.table_id not in tables:
        raise RollOffError("the table is not registered")
    for other in cold:
        if other.table_id == report.table_id and other.state == "promoted" and other.object_path != report.object_path:
            theirs = day_range(other.object_path)
            if theirs is None:
                raise RollOffError("a promoted object has no readable day range")
            if days_overlap(days, theirs):
                raise RollOffError("a promoted object already covers one of the days")
    same = next((c for c in cold if (c.table_id, c.object_path) == (report.table_id, report.object_path)), None)
    if same and same.project_id != report.project_id:
        raise RollOffError("another project has entered this day")
    serving = sorted(p.id for p in placements if (p.table_id, p.project_id, p.state) == (report.table_id, report.project_id, "serving"))
    if not serving:
        raise RollOffError("no placement serves the table on this project")
    if placement_id is not None and placement_id not in serving:
        raise RollOffError("the named placement does not serve")
    if placement_id is None and len(serving) > 1:
        raise RollOffError("several placements serve; name one")
    chosen = placement_id or serving[0]
    entered = replace(report, schema_version=tables[report.table_id], state="promoted", key=same.key if same else report.key)
    objects = [entered if c is same else c for c in cold] + ([] if same else [entered])
    moved = [replace(p, bytes_used=remaining_bytes or 0) if p.id == chosen else p for p in placements]
    return objects, moved, {"placement_id": chosen, "superseded": same is not None}
