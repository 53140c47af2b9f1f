"""Distances between vector columns; for all of them, lower is closer. Sums are taken in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot_product", "manhattan")
DEFAULT_METRIC = "cosine"


def metric_named(name: str) -> str | None:
    """The metric of a name in any case, None for an unknown one."""
    return {"cosine": "cosine", "euclidean": "euclidean", "dot_product": "dot_product", "dotproduct": "dot_product", "manhattan": "manhattan"}.get(name.lower())


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _both(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot / sqrt(|a|^2 |b|^2); 1 where either is zero."""
    scale = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(scale == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / scale)


def squared_euclidean_distance(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: (x - y) * (x - y))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean_distance(a, b))


def dot_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def manhattan_distance(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: F.abs(x - y))


def distance(a: Column, b: Column, metric: str = DEFAULT_METRIC) -> Column:
    return {"cosine": cosine_distance, "euclidean": euclidean_distance, "dot_product": dot_product_distance, "manhattan": manhattan_distance}[known(metric)](a, b)


def known(metric: str) -> str:
    if (name := metric_named(metric)) is None:
        raise ValueError(f"unknown metric {metric!r}")
    return name


def similarity(distance: Column, metric: str) -> Column:
    """cosine 1 - d; dot product -d; euclidean and manhattan 1 / (1 + d)."""
    return {"cosine": 1 - distance, "dot_product": -distance}.get(known(metric), 1 / (1 + distance))


def normalized(a: Column, strict: bool = False) -> Column:
    """a at length 1. A zero vector stays as it is, or is an error if strict."""
    n = norm(a)
    zero = F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>") if strict else F.transform(a, lambda x: x.cast("double"))
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(zero)


def checked(a: Column, dimension: int) -> Column:
    """a, or an error if its length isn't dimension or it holds NaN or an infinity."""
    bad = F.exists(a, lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(a) == dimension) & ~bad, a).otherwise(F.raise_error(F.lit(f"not {dimension} finite numbers")).cast("array<float>"))


#: Below this share of both lengths' squares a squared distance from products has lost half of its digits.
CANCELS = 1e-8


def pairwise(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """len(queries) x len(vectors) distances of two matrices, by matrix products where the metric allows."""
    queries, vectors = np.asarray(queries, np.float64), np.asarray(vectors, np.float64)
    metric = known(metric)
    if metric == "manhattan":
        return np.stack([np.abs(vectors - q).sum(1) for q in queries]) if len(queries) else np.zeros((0, len(vectors)))
    products = queries @ vectors.T
    if metric == "dot_product":
        return -products
    q2, v2 = (queries**2).sum(1)[:, None], (vectors**2).sum(1)[None, :]
    if metric == "cosine":
        scale = np.sqrt(q2 * v2)
        return np.where(scale == 0, 1.0, 1 - products / np.where(scale == 0, 1, scale))
    squares = np.maximum(q2 + v2 - 2 * products, 0)
    # near copies: their squares cancel, so they are measured by their differences
    i, j = np.nonzero(squares < CANCELS * (q2 + v2))
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        squares[a, b] = ((queries[a] - vectors[b]) ** 2).sum(1)
    return np.sqrt(squares)
