"""Multi-key order with a direction and a place for nulls for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_key(name: str, descending: bool = False, nulls_first: bool = False) -> Column:
    column = F.col(f"`{name}`")
    if descending:
        return column.desc_nulls_first() if nulls_first else column.desc_nulls_last()
    return column.asc_nulls_first() if nulls_first else column.asc_nulls_last()


def ordered(rows: DataFrame, keys: Sequence[tuple[str, bool, bool]]) -> DataFrame:
    """Rows by (column, descending, nulls first); texts compare by code point."""
    return rows.orderBy(*[sort_key(*k) for k in keys])
