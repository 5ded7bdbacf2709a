"""A value computed once, for functions that name their argument many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: where functions are nested, the expression would else grow by a factor at each level."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
