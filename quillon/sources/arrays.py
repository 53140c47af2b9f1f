"""Collections seen through numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quillon.operators import vmath
from quillon.operators.knn import search
from quillon.sources.collection import Collection, np_insert, np_search

__all__ = ["Clustered", "Reduced", "np_centroid", "np_cluster", "np_get", "np_insert", "np_interpolate", "np_pca", "np_search", "search"]


@dataclass(frozen=True)
class Reduced:
    components: np.ndarray
    explained_variance: np.ndarray
    mean: np.ndarray
    projected: DataFrame  # (id, projected), as many rows as the collection


@dataclass(frozen=True)
class Clustered:
    centroids: np.ndarray
    assignments: DataFrame
    iterations: int
    converged: bool


def np_get(collection: Collection, id: int) -> tuple[np.ndarray, dict] | None:
    """(vector, metadata), None if the id isn't there."""
    row = collection.get(id)
    if row is None:
        return None
    bag = row.asDict()
    return np.array(bag.pop("embedding"), np.float32), {k: v for k, v in bag.items() if k not in ("id", "version")}


def np_centroid(collection: Collection, ids=None, weights=None) -> np.ndarray:
    return np.array(vmath.centroid(collection.load(), ids, weights), np.float32)


def np_interpolate(a: np.ndarray, b: np.ndarray, t: float = 0.5, method: str = "lerp") -> np.ndarray:
    return np.array({"lerp": vmath.lerp, "slerp": vmath.slerp}[method](a.tolist(), b.tolist(), t), np.float32)


def np_pca(collection: Collection, n_components: int) -> Reduced:
    rows = collection.load()
    found = vmath.pca(rows, n_components)
    return Reduced(np.array(found.components), np.array(found.explained_variance), np.array(found.mean), found.transform(rows))


def np_cluster(collection: Collection, k: int, seed: int = 0) -> Clustered:
    found = vmath.kmeans(collection.load(), k, seed=seed)
    return Clustered(np.array(found.centroids), found.assignments, found.iterations, found.converged)
