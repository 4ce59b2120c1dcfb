"""Computing a value once where an expression uses it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value bound to a lambda variable, so costly parsing is not repeated."""
    return F.transform(F.array(value), use).getItem(0)
