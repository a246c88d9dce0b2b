"""Log positions ``X/Y``: two hexadecimal halves of up to eight digits, compared as numbers."""

from __future__ import annotations

import re
from typing import Any


def parse_lsn(value: Any) -> tuple[int, int] | None:
    """The halves, or None for anything that is not a position."""
    if not isinstance(value, str) or not re.fullmatch(r"[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}", value):
        return None
    high, low = value.split("/")
    return int(high, 16), int(low, 16)


def lsn_at_least(applied: Any, floor: Any) -> bool | None:
    """Whether ``applied`` has reached ``floor``; None if either cannot be read."""
    a, f = parse_lsn(applied), parse_lsn(floor)
    return None if a is None or f is None else a >= f
