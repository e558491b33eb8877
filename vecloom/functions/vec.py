"""Vector algebra on ARRAY<FLOAT|DOUBLE> columns, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, though ``f`` may use it for every element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def doubles(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def total(v: str | Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product; no normalisation."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: str | Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(doubles(v), lambda d: let(F.greatest(norm(d), F.lit(1e-12)), lambda n: F.transform(d, lambda x: x / n)))


def subtract(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def rescale(v: str | Column, norm_kind: str = "l2") -> Column:
    """Divide by the norm, or with ``squared`` by its square; zero vectors stay zero."""
    if norm_kind not in ("l2", "squared"):
        raise ValueError(f"unknown norm: {norm_kind}")
    size = norm if norm_kind == "l2" else lambda d: dot(d, d)
    return let(doubles(v), lambda d: let(size(d), lambda by: F.transform(d, lambda x: F.coalesce(F.try_divide(x, by), F.lit(0.0)))))


def next_power_of_two(x: str | Column) -> Column:
    """Least power of two that is at least x, by the bits of x - 1."""
    bits = F.length(F.bin(F.greatest(col(x).cast("long") - 1, F.lit(0)).cast("long")))
    return F.when(col(x) <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), bits)).cast("long")


def pool(states: str | Column, mask: str | Column | None = None, how: str = "mean") -> Column:
    """Pool an ARRAY<ARRAY<DOUBLE>> of token states: masked mean, cls, last, max, or none for the states themselves, NaN where masked."""
    s = col(states)
    if how == "none":
        return s if mask is None else F.transform(s, lambda t, i: F.transform(t, lambda x: F.when(F.get(col(mask), i) > 0, x).otherwise(F.lit(float("nan")))))
    kept = s if mask is None else F.filter(s, lambda _, i: F.get(col(mask), i) > 0)
    if how == "cls":
        return F.get(s, F.lit(0))
    if how == "last":
        return F.get(kept, F.size(kept) - 1)
    dims = F.sequence(F.lit(0), F.size(F.get(s, F.lit(0))) - 1)
    if how == "max":
        return F.transform(dims, lambda d: F.array_max(F.transform(kept, lambda t: F.get(t, d))))
    if how == "mean":
        return F.transform(dims, lambda d: F.try_divide(total(F.transform(kept, lambda t: F.get(t, d))), F.size(kept)))
    raise ValueError(f"unknown pooling: {how}")
