"""Vector algebra on array columns (V1-V3, V7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed in double precision from the first element on; null if lengths differ."""
    a, b = _c(a), _c(b)
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalized(a: Column | str) -> Column:
    """Vector of unit norm in double precision; a zero vector stays as it is.

    The norm is bound by a one-element array, or it would be summed anew for each element.
    """
    n = norm(a)
    safe = F.array(F.when(n > 0, n).when(n == 0, F.lit(1.0)))
    return F.transform(safe, lambda m: F.transform(_c(a), lambda x: x.cast("double") / m))[0]


def finite(a: Column | str) -> Column:
    return F.forall(_c(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def concatenated(a: Column | str, b: Column | str) -> Column:
    """Two descriptors side by side, of unit norm."""
    return l2_normalized(F.concat(_c(a), _c(b)))
