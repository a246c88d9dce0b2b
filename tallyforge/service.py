"""Routes and authorisation as one function; any HTTP server can call it."""

from __future__ import annotations

import hmac
import json
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from tallyforge.errors import EngineError, malformed
from tallyforge.functions import snapshot
from tallyforge.plans.catalog import directory_rows, plain
from tallyforge.plans.envelope import refuse, respond
from tallyforge.plans.executor import Limits, Table, execute
from tallyforge.plans.geo import Planes, is_write, write_gate
from tallyforge.plans.request import parse_request

log = logging.getLogger(__name__)

# The answer to a preflight.
CORS = {
    "Access-Control-Allow-Origin": "*",
    "Access-Control-Allow-Methods": "GET,POST,OPTIONS",
    "Access-Control-Allow-Headers": "Authorization, Content-Type, apikey",
    "Access-Control-Max-Age": "86400",
}


@dataclass
class Service:
    """The engine behind routes; ``config`` has ``read_only``, ``write_epoch`` and ``primary_override``.

    With ``directory``, a table's placements are the rows of that name which it returns
    beside the version, and with ``snapshot_key`` they are signed for clients to send
    back. ``stamp`` notes the shards that answered. ``strict_templates`` refuses plans that
    no template serves, ``read_your_writes`` allows ``min_lsn``.
    """

    tables: Mapping[str, Table]
    token: str | None
    version: Callable[[], int] = lambda: 0
    config: Mapping[str, Any] | None = None
    directory: Callable[[], tuple[int, list[dict]]] | None = None
    snapshot_key: str | None = None
    planes: Planes | None = None
    stamp: Callable[[list[str]], Any] | None = None
    strict_templates: bool = False
    read_your_writes: bool = False
    limits: Limits | None = None
    shard_timeout: float | None = None

    def _authorise(self, headers: Mapping[str, str]) -> tuple[int, dict] | None:
        if not self.token:
            return refuse(EngineError("internal", "the server has no token"))
        given = headers.get("authorization", "")
        kind = None
        if not given.startswith("Bearer "):
            kind = "missing_bearer"
        elif not hmac.compare_digest(given.removeprefix("Bearer ").encode(), self.token.encode()):
            kind = "invalid_token"
        elif "apikey" not in headers:
            kind = "bad_apikey"
        if kind is None:
            return None
        _, body = refuse(malformed("authorisation failed"))
        body["error"]["auth_kind"] = kind
        return 401, body

    def handle(self, method: str, path: str, headers: Mapping[str, str], body: str = "") -> tuple[int, Any]:
        """Status and body; a preflight's body is its headers."""
        route = path.rstrip("/")
        if method == "OPTIONS":
            return 204, CORS
        if (method, route) == ("GET", "/health"):
            return 200, {"v": 1, "ok": True, "directory_version": self.version(), "engine_build": None}
        if failed := self._authorise({k.lower(): v for k, v in headers.items()}):
            return failed
        known: dict[str, Any] = {"qid": None, "version": None}
        try:
            if (method, route) != ("POST", "/query"):
                raise malformed("no such route")
            try:
                raw = json.loads(body)
            except ValueError:
                raise malformed("the body is not JSON") from None
            known["qid"] = raw.get("qid") if isinstance(raw, dict) and isinstance(raw.get("qid"), str) else None
            if is_write(raw):
                write_gate(self.config or {}, raw.get("write_epoch"), "write_epoch" in raw)
                raise malformed("writes are not offered")
            return 200, self._query(raw, known)
        except EngineError as error:
            return refuse(error, known["qid"], known["version"])
        except Exception:  # noqa: BLE001  what was not foreseen goes to the log and not to the client
            log.exception("query failed")
            return refuse(EngineError("internal", "internal engine error"), known["qid"], known["version"])

    def _placements(self, token: str | None, known: dict) -> tuple[list[dict] | None, bool]:
        """Directory rows, and whether they come from the client's snapshot; that is used only if nothing speaks against it."""
        if self.directory is None:
            known["version"] = self.version()
            return None, False
        if token is not None and self.snapshot_key is not None:
            known["version"] = self.version()
            seen = snapshot.verify(token, self.snapshot_key, known["version"])
            if seen.ok and isinstance(seen.payload, list):
                return seen.payload, True
        known["version"], rows = self.directory()
        return rows, False

    def _query(self, raw: Any, known: dict) -> dict:
        request = parse_request(raw)
        if request.min_lsn is not None and not self.read_your_writes:
            raise malformed("min_lsn needs read-your-writes, which is off")
        rows, replayed = self._placements(request.snapshot, known)
        tables = self.tables
        if rows is not None:
            tables = {n: replace(t, directory=directory_rows(rows, n)) for n, t in tables.items()}
        planes = self.planes or Planes()
        planes = replace(planes, override=(self.config or {}).get("primary_override", planes.override))
        answer = execute(request, tables, limits=self.limits, strict_templates=self.strict_templates, planes=planes, shard_timeout=self.shard_timeout)
        most = (self.limits or Limits()).groups
        body = respond(answer, request.qid, most) | {"directory_version": known["version"]}
        if rows is not None and not replayed and self.snapshot_key is not None:
            body["directory_snapshot"] = snapshot.sign(plain(rows), known["version"], self.snapshot_key)
        if self.stamp is not None and answer.responded:
            try:
                self.stamp(list(answer.responded))
            except Exception:  # noqa: BLE001  a missed stamp only ages
                log.warning("the shards' health could not be stamped")
        return body
