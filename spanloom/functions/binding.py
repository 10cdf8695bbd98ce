"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it.

    Spark may copy a column's expression to each place that uses it; a lambda
    variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
