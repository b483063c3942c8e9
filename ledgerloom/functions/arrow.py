"""Arrow-batched functions that are built where they are used: modules stay importable on workers, which have no JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.pandas_udf(f, return_type)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
