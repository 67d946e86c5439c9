"""Dense and sparse vector maths as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.binding import bind
from sitegauge.functions.urls import _col

EPSILON = 1e-9


def as_double(vector: Column | str) -> Column:
    return _col(vector).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column | str) -> Column:
    """Vector of length one; a zero vector stays zero."""
    return bind(
        norm(a), lambda n: F.transform(_col(a), lambda x: F.when(n > 0, x / n).otherwise(x))
    )


def is_usable(vector: Column | str, dimensions: int | None = None) -> Column:
    """True for a non-empty vector without null, NaN or infinite entries."""
    v = _col(vector)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    size_ok = F.size(v) == dimensions if dimensions else F.size(v) > 0
    return F.coalesce(v.isNotNull() & size_ok & finite, F.lit(False))


def sparse_dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two ``map<string,double>`` vectors."""
    products = F.map_zip_with(_col(a), _col(b), lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(F.map_values(products), F.lit(0.0), lambda s, x: s + x)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
