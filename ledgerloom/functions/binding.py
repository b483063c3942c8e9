"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once a row.

    An expression that mentions a value several times, some of them in branches, computes it anew each time;
    bound as the variable of a higher-order function, it is computed once.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
