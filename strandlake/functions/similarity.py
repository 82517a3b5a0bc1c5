"""Overlap similarity of doc-id lists and set helpers (SIM-1..9, SET-1..6, LCP-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("direct", "square", "sharp")


def content_set(ids: Column) -> Column:
    """Canonical content: sorted distinct ids."""
    return F.array_sort(F.array_distinct(ids))


def scale(x: Column, method: str = "sharp") -> Column:
    """Similarity from the overlap ratio x; an unknown method is an error (D4)."""
    if method == "direct":
        return x
    if method == "square":
        return x * x
    if method == "sharp":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.exp(2 * x * x) - 1) / (F.exp(F.lit(2.0)) - 1)))
    raise ValueError(f"unknown similarity method {method!r}; known: {METHODS}")


def overlap_similarity(a: Column, b: Column, method: str = "sharp") -> Column:
    """Similarity of two id lists over the longer one's length; 0 if either is empty (D7)."""
    x = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(scale(x, method))


def distance(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - similarity)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the equal leading run."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    step = lambda s, e: F.struct((s["n"] + F.when(s["go"] & e, 1).otherwise(0)).alias("n"), (s["go"] & e).alias("go"))
    return F.aggregate(same, start, step, lambda s: s["n"])


def multiset_overlap(a: Column, b: Column) -> Column:
    """Common tokens with multiplicity: the size of the intersection if either list repeats none, else one walk over both
    sorted together, tokens of ``a`` first. Both are named more than once: columns, not expressions."""
    single = lambda xs: F.array_size(F.array_distinct(xs)) == F.array_size(xs)
    side = lambda xs, n: F.transform(xs, lambda t: F.struct(t.alias("t"), F.lit(n).alias("side")))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("open"), F.lit(0).alias("n"))

    def step(s, x):
        held = F.when(s["t"] == x["t"], s["open"]).otherwise(F.lit(0))
        hit = (x["side"] == 1) & (held > 0)
        one = F.when(hit, F.lit(1)).otherwise(F.lit(0))
        return F.struct(x["t"].alias("t"), (held + F.when(x["side"] == 0, F.lit(1)).otherwise(-one)).alias("open"), (s["n"] + one).alias("n"))

    walk = F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), start, step, lambda s: s["n"])
    return F.when(single(a) | single(b), F.array_size(F.array_intersect(a, b))).otherwise(walk)
