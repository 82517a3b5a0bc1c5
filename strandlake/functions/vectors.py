"""Vector expressions in double precision (VEC-1..5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """The vector over its norm, which is taken once."""
    return F.zip_with(v, F.array_repeat(F.greatest(norm(v), F.lit(eps)), F.size(v)), lambda x, n: x / n)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the attended token vectors: sum(mask * h) / max(sum(mask), 1e-9)."""
    weight = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    zero = F.transform(tokens[0], lambda _: F.lit(0.0))
    rows = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x * m))
    total = F.aggregate(rows, zero, lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(weight, F.lit(1e-9)))


def last_token_pool(tokens: Column, mask: Column) -> Column:
    """The last token's vector if the row is left-padded, else that of the last attended token."""
    attended = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m).cast("int")
    return F.when(F.element_at(mask, -1) == 1, F.element_at(tokens, -1)).otherwise(F.element_at(tokens, F.greatest(attended, F.lit(1))))


def cls_pool(tokens: Column) -> Column:
    return F.element_at(tokens, 1)
