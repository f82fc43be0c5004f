"""Column functions on ``ARRAY<DOUBLE>`` vectors, built from higher-order functions.

A value used in every element's lambda is bound with ``let`` first, so it is computed once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vector(x: Column | str) -> Column:
    """A numeric array as doubles."""
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def scaled(x: Column, by: Column) -> Column:
    return let(by, lambda s: F.transform(x, lambda v: v * s))


def added(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def center(x: Column) -> Column:
    """Row mean moved to 0."""
    return let(x, lambda c: let(total(c) / F.size(c), lambda m: F.transform(c, lambda v: v - m)))


def snv_struct(x: Column, eps: float = 1e-12) -> Column:
    """Standard normal variate of a row with its statistics: struct of ``y``, ``mu`` and ``sd``.

    ``y = (x - mean) / sd``; ``sd`` has one degree of freedom less than the row has values (none less for
    a single value) and already holds ``eps``.
    """
    spread = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v) / F.greatest(F.size(c) - 1, F.lit(1))) + F.lit(eps)
    by_sd = lambda c, mu: let(spread(c), lambda sd: F.struct(F.transform(c, lambda v: v / sd).alias("y"), mu.alias("mu"), sd.alias("sd")))
    return let(total(x) / F.size(x), lambda mu: let(F.transform(x, lambda v: v - mu), lambda c: by_sd(c, mu)))


def snv(x: Column, eps: float = 1e-12) -> Column:
    return snv_struct(x, eps)["y"]


def inverse_snv(y: Column, mu: Column, sd: Column) -> Column:
    return F.transform(y, lambda v: v * sd + mu)


def l2_normalize(x: Column, eps: float = 1e-6) -> Column:
    """``x / max(norm, eps)``; a zero row stays zero."""
    return let(F.greatest(norm(x), F.lit(eps)), lambda n: F.transform(x, lambda v: v / n))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of rows that are normalised."""
    return dot(a, b)


def cosine_dissimilarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def fractional_shift(x: Column, delta: Column) -> Column:
    """The row read at ``i - delta`` by linear interpolation; positions beyond its ends read the end."""

    def at(d: Column, i: Column) -> Column:
        place = i.cast("double") - d
        left = F.floor(place)
        clamp = lambda p: F.get(x, F.greatest(F.lit(0), F.least(F.size(x) - 1, p)).cast("int"))
        alpha = place - left
        return (F.lit(1.0) - alpha) * clamp(left) + alpha * clamp(left + 1)

    return let(delta, lambda d: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: at(d, i)))


def renorm_like(x: Column, reference: Column, eps: float = 1e-8) -> Column:
    """``x`` scaled to the reference's norm; the reference itself where ``x`` has next to none."""
    return let(norm(x), lambda n: F.when(n <= eps, reference).otherwise(scaled(x, norm(reference) / F.greatest(n, F.lit(eps)))))


def reproject(x: Column, reference: Column, recenter: bool = True, renorm: bool = True, eps: float = 1e-8) -> Column:
    """Centred and scaled back to the reference's sphere."""
    out = center(x) if recenter else x
    return let(out, lambda c: renorm_like(c, reference, eps)) if renorm else out


def tangent(base: Column, direction: Column, eps: float = 1e-8) -> Column:
    """The centred direction without its part along ``base``."""
    moved = lambda c: let(dot(c, base) / F.greatest(dot(base, base), F.lit(eps)), lambda k: F.zip_with(c, base, lambda a, b: a - k * b))
    return let(center(direction), moved)


def rotate_along(base: Column, direction: Column, angle: Column, eps: float = 1e-8) -> Column:
    """``base`` turned by an angle (radians) along the tangent of ``direction``; kept where the tangent vanishes."""

    def turned(t: Column) -> Column:
        n, b = norm(t), F.greatest(norm(base), F.lit(eps))
        along = scaled(t, b * F.sin(angle) / F.greatest(n, F.lit(eps)))
        return F.when(n <= eps, base).otherwise(added(scaled(base, F.cos(angle)), along))

    return let(tangent(base, direction, eps), turned)
