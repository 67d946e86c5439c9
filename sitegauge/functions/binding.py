"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with *value* computed once per row.

    A plain column would be inlined by the optimizer into lambdas and computed again for
    every array element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]
