"""Vector functions on ``array<double>`` columns.

Vectors stay plain arrays at rest; higher-order functions keep the work in the
JVM.  ``VectorUDT`` appears only at the MLlib edge (see operators.linear).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POOL_METHODS = ("max", "mean", "first")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pool(hidden_states: Column | str, method: str = "max", top_n: int = 3, strict: bool = True) -> Column:
    """pool a ``[steps][dim]`` activation list into one ``dim`` vector.

    max/mean are element-wise over the first ``top_n`` steps (fewer when the
    list is shorter); ``first`` is step 0.  Like the reference, an empty list
    or ragged steps are errors (``strict``); with ``strict=False`` they give
    NULL instead.  NaN propagates.
    """
    if method not in POOL_METHODS:
        raise ValueError(f"Unknown method {method}")
    if top_n < 1:
        raise ValueError("top_n must be >= 1")
    hs = _c(hidden_states)
    head = F.slice(hs, 1, top_n)
    first = F.get(hs, 0)
    if method == "first":
        out = first
    else:
        rest = F.slice(hs, 2, top_n - 1) if top_n > 1 else F.array().cast("array<array<double>>")
        if method == "max":
            out = F.aggregate(rest, first, lambda a, b: F.zip_with(a, b, lambda u, v: F.greatest(u, v)))
        else:
            total = F.aggregate(rest, first, lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
            out = F.transform(total, lambda v: v / F.size(head))
    bad = (F.size(hs) == 0) | ~F.forall(head, lambda s: F.size(s) == F.size(first))
    if strict:
        return F.when(hs.isNull(), F.lit(None)).when(
            bad, F.raise_error(F.lit("hidden_states: empty or ragged activation list"))
        ).otherwise(out)
    return F.when(hs.isNull() | bad, F.lit(None)).otherwise(out)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda u, v: u * v), F.lit(0.0), lambda acc, t: acc + t)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, t: acc + t * t))


def cosine(a: Column | str, b: Column | str) -> Column:
    """cosine similarity; a zero vector gives 0 (library convention)."""
    denom = l2_norm(a) * l2_norm(b)
    return F.coalesce(dot(a, b) / F.nullif(denom, F.lit(0.0)), F.lit(0.0))


def sigmoid(z: Column | str) -> Column:
    """class-1 probability of a linear model from its margin."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def softmax2_class1(z0: Column | str, z1: Column | str) -> Column:
    """softmax over two logits, probability of class 1 (stable form)."""
    return sigmoid(_c(z1) - _c(z0))
