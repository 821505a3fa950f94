"""Vector columns: everything here is a Column expression evaluated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing (0)."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(inner_product(a, b) / size)


def normalise(a: Column, eps: float = 0.0) -> Column:
    """Unit length; a zero vector stays as it is. eps is added to the length when given."""
    size = norm(a) + F.lit(float(eps))
    size = F.when(size == 0, F.lit(1.0)).otherwise(size)
    return F.transform(a, lambda x: x / size)


def round6(c: Column) -> Column:
    """Six decimals, never minus zero: engines add floats in different orders."""
    return F.round(c, 6) + F.lit(0.0)


def quantise(x: Column, lo: Column, hi: Column, bits: int, eps: float = 1e-12) -> Column:
    """Min-max scaled to the integer grid 0 .. 2**bits - 1."""
    return F.floor((x - lo) / (hi - lo + F.lit(eps)) * ((1 << bits) - 1)).cast("long")


def affine(x: Column, rows: list[list[float]]) -> Column:
    """x . A for a constant matrix given by its columns."""
    return F.array(*[inner_product(x, F.array(*[F.lit(float(c)) for c in column])) for column in rows])
