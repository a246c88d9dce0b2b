"""The response as a plain dict: exact numbers as scaled integers."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from typing import Any

from tallyforge.errors import EngineError
from tallyforge.functions.canonical import ColumnType, render_timestamp
from tallyforge.plans.executor import MAX_GROUPS, Answer, collect_groups


def scaled(value: Any, kind: ColumnType | None) -> int | None:
    """613.95 at scale 2 is 61395; null stays null."""
    if value is None:
        return None
    return int(Decimal(value).scaleb(kind.scale if kind and kind.name == "numeric" else 0))


def respond(answer: Answer, qid: str, most: int | None = MAX_GROUPS) -> dict:
    """Collects the rows, bounded by the group limit, and lets go of what was kept for them."""
    try:
        found = collect_groups(answer, most)
    finally:
        answer.close()
    out = []
    for row in found:
        item: dict[str, Any] = {}
        for key, _ in answer.plan.keys:
            item[key] = render_timestamp(row[key]) if isinstance(row[key], datetime) else row[key]
        for name, (aggregate, kind) in answer.plan.aggregates.items():
            if aggregate.op == "avg":
                num, den = row[f"{name}_num"], row[f"{name}_den"]
                item[name] = None if den is None else {"num": scaled(num, kind), "den": den}
            else:
                item[name] = row[name] if aggregate.op == "count" else scaled(row[name], kind)
        out.append(item)
    responded, asked = answer.coverage
    body: dict[str, Any] = {
        "v": 1, "qid": qid, "coverage": f"{responded}/{asked}", "coverage_ratio": answer.ratio, "partial": answer.partial,
        "warnings": answer.warnings, "perShard": answer.per_shard, "latency_ms": answer.latency_ms,
    }
    return body | ({"rows": out} if answer.plan.grouped else {"result": out[0] if out else None})


def refuse(error: EngineError, qid: str | None = None, version: int | None = None) -> tuple[int, dict]:
    """Status and body of an error."""
    body: dict[str, Any] = {"v": 1, "qid": qid, "error": {"code": error.code, "message": str(error)}}
    if version is not None:
        body["directory_version"] = version
    if error.per_shard is not None:
        body["perShard"] = error.per_shard
    return error.status, body
