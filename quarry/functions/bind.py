"""Giving a value a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once a row however often it is used, also within loops over arrays."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)
