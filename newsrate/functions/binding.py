"""Naming intermediate values, so that an expensive expression runs once per row.

Catalyst substitutes a column's expression wherever a later filter or projection uses it; a
regular expression or a split would then run several times, and nested ones would multiply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose values are fixed here: filters on them stay above this point. Other
    filters still pass."""
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))
