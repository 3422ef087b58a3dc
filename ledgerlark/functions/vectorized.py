"""Pandas UDFs that are made where they are applied, so that workers can import their modules without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorates a function of pandas Series; the result takes columns or their names."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def apply(*columns: Column | str) -> Column:
            return F.pandas_udf(f, return_type)(*columns)

        apply.__doc__, apply.__name__ = f.__doc__, f.__name__
        return apply

    return wrap
