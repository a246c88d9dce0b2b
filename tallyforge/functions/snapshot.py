"""Signed directory snapshots: ``base64(json).base64(hmac-sha256)``."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

# How old a snapshot may be, and how far ahead a clock.
MAX_AGE, MAX_SKEW = timedelta(seconds=60), timedelta(seconds=5)


@dataclass(frozen=True)
class Verified:
    ok: bool
    reason: str = ""
    payload: Any = None


def _mac(key: str, segment: str) -> bytes:
    return hmac.new(key.encode(), segment.encode(), hashlib.sha256).digest()


def sign(payload: Any, version: int, key: str, now: datetime | None = None) -> str:
    issued = (now or datetime.now(timezone.utc)).isoformat()
    blob = json.dumps({"version": version, "issued_at": issued, "payload": payload}, separators=(",", ":"))
    segment = base64.b64encode(blob.encode()).decode()
    return f"{segment}.{base64.b64encode(_mac(key, segment)).decode()}"


def verify(token: Any, key: str, version: int, now: datetime | None = None) -> Verified:
    """Signature, then form, then age, then version; a refusal carries its reason."""
    if not isinstance(token, str) or len(parts := token.split(".")) != 2 or not all(parts):
        return Verified(False, "not two segments")
    try:
        signature = base64.b64decode(parts[1], validate=True)
    except ValueError:
        return Verified(False, "signature is not base64")
    if not hmac.compare_digest(signature, _mac(key, parts[0])):
        return Verified(False, "signature differs")
    try:
        blob = json.loads(base64.b64decode(parts[0], validate=True))
        issued = datetime.fromisoformat(blob["issued_at"])
        own, payload = blob["version"], blob["payload"]
    except (ValueError, KeyError, TypeError):
        return Verified(False, "content cannot be read")
    if type(own) is not int or own < 0 or issued.tzinfo is None:
        return Verified(False, "content cannot be read")
    age = (now or datetime.now(timezone.utc)) - issued
    if age > MAX_AGE:
        return Verified(False, "expired")
    if age < -MAX_SKEW:
        return Verified(False, "issued in the future")
    return Verified(True, payload=payload) if own == version else Verified(False, "version differs")
