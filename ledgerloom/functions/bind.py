"""Name a value inside an expression, so that it is worked out once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value evaluated once; a null value is passed on as null."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
