"""A name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    Inside lambdas the engine shares no common expressions, so a value that is used many
    times would be computed, and planned, as often.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
