"""The four column types and their exact values.

Values in requests are parsed strictly: a rendering that would lose something is
refused and never coerced. On data columns Spark's exact types carry the same law:
``int8`` as long, ``numeric`` as decimal, ``text`` by code point, ``timestamptz`` in UTC.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.errors import malformed

TYPES = ("int8", "numeric", "text", "timestamptz")
SAFE_INTEGER = 2**53 - 1
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
TIMESTAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?(Z|[+-]\d\d(?::?\d\d)?))?")


@dataclass(frozen=True)
class ColumnType:
    """A column's type; ``scale`` counts for numeric alone."""

    name: str
    scale: int = 0

    def __post_init__(self):
        if self.name not in TYPES:
            raise malformed("column type must be int8, numeric, text or timestamptz")
        if type(self.scale) is not int or not 0 <= self.scale <= 18:
            raise malformed("column scale must be an integer from 0 to 18")

    @property
    def sql(self) -> str:
        return {"int8": "bigint", "numeric": f"decimal(38,{self.scale})", "text": "string", "timestamptz": "timestamp"}[self.name]

    def column(self, column: Column) -> Column:
        """A data column in this type."""
        return column.cast(self.sql)

    def parse(self, value: Any) -> Any:
        """A request value as int, Decimal, str or aware datetime; None stays None."""
        if value is None:
            return None
        return getattr(self, f"_{self.name}")(value)

    def _int8(self, value: Any) -> int:
        if isinstance(value, bool) or not isinstance(value, int | float | str):
            raise malformed("int8 takes an integer or its digits")
        if isinstance(value, str):
            if not re.fullmatch(r"-?[0-9]+", value):
                raise malformed("int8 takes an integer or its digits")
            value = int(value)
        if isinstance(value, float):
            if not value.is_integer() or abs(value) > SAFE_INTEGER:
                raise malformed("int8 number is not an exact integer")
            value = int(value)
        if not -(2**63) <= value < 2**63:
            raise malformed("int8 value is out of range")
        return value

    def _numeric(self, value: Any) -> Decimal:
        if isinstance(value, bool) or not isinstance(value, int | float | str | Decimal):
            raise malformed("numeric takes a number or its decimal text")
        if isinstance(value, float) and (value != value or abs(value) > SAFE_INTEGER):
            raise malformed("numeric number is not exact")
        text = repr(value) if isinstance(value, float) else str(value)
        match = re.fullmatch(r"(-?)([0-9]+)(?:\.([0-9]+))?", text)
        if not match:
            raise malformed("numeric takes plain decimal digits")
        if len((match[3] or "").rstrip("0")) > self.scale:
            raise malformed("numeric value has more decimals than the column")
        return Decimal(text).quantize(Decimal(1).scaleb(-self.scale)) if len(match[2]) + self.scale < 28 else Decimal(text)

    def _text(self, value: Any) -> str:
        if not isinstance(value, str):
            raise malformed("text takes a string")
        return value

    def _timestamptz(self, value: Any) -> datetime:
        if isinstance(value, bool) or not isinstance(value, int | float | str):
            raise malformed("timestamptz takes ISO text or epoch milliseconds")
        try:
            if isinstance(value, int | float):
                if abs(value) > SAFE_INTEGER or int(value) != value:
                    raise malformed("epoch milliseconds must be an exact integer")
                return EPOCH + timedelta(milliseconds=int(value))
            match = TIMESTAMP.fullmatch(value)
            if not match:
                raise malformed("timestamptz text must be a date or a full time with offset")
            year, month, day, hour, minute, second, fraction, zone = match.groups()
            at = datetime(int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0), int((fraction or "").ljust(6, "0")), timezone.utc)
            if zone and zone != "Z":
                digits = zone[1:].replace(":", "")
                hours, minutes = int(digits[:2]), int(digits[2:] or 0)
                if hours > 23 or minutes > 59:
                    raise malformed("timestamptz offset is out of range")
                at -= timedelta(hours=hours, minutes=minutes) * (-1 if zone[0] == "-" else 1)
            return at
        except (ValueError, OverflowError):
            raise malformed("timestamptz value is not a calendar time") from None

    def literal(self, value: Any) -> Column:
        """A request value as a literal of this type."""
        parsed = self.parse(value)
        if isinstance(parsed, datetime):
            parsed = parsed.isoformat(sep=" ", timespec="microseconds")
        if isinstance(parsed, Decimal):
            parsed = str(parsed)
        return F.lit(parsed).cast(self.sql)


def render_timestamp(at: datetime) -> str:
    """The fixed-width UTC form of a time."""
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    return f"{at.year:04d}-{at:%m-%dT%H:%M:%S}.{at.microsecond:06d}Z"
