"""Vector mathematics: centroids, ghosts, cones, drift, clustering, principal components, analogies, diversity."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.distance import cosine_distance, distance, dot, known, norm, normalized, pairwise, vector
from quillon.lineage import cut
from quillon.operators.knn import BLOCK_BYTES, PAIRS, PIECE, TILE, matrix


def metric_or_euclidean(name: str | None) -> str:
    """Vector mathematics takes euclidean for a blank or unknown name."""
    try:
        return known(name or "euclidean")
    except ValueError:
        return "euclidean"


def chosen(vectors: DataFrame, ids: Sequence[int] | DataFrame | None) -> DataFrame:
    """The vectors of some ids; of none, all. Ids that aren't there are left out."""
    if ids is None or not isinstance(ids, DataFrame) and not ids:
        return vectors
    wanted = ids.select("id") if isinstance(ids, DataFrame) else vectors.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
    return vectors.join(wanted.distinct(), "id", "left_semi")


def centroid_table(vectors: DataFrame, weight: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., centroid, n): the (weighted) mean of each group, added up before the shuffle."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    parts = vectors.select(*keys, w.alias("w"), F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy(*keys, "at").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def centroid(vectors: DataFrame, ids=None, weights: Sequence[float] | None = None) -> list[float]:
    """The mean, or the mean by weights in order of the ids found; an error for no vectors, a wrong count or weights that add up to 0."""
    rows = chosen(vectors, ids)
    if weights is None:
        found = centroid_table(rows).first()
        if not found["n"]:
            raise LookupError("no vectors")
        return list(found["centroid"])
    order = [r["id"] for r in rows.select("id").orderBy("id").limit(len(weights) + 1).collect()]
    if ids is not None and not isinstance(ids, DataFrame) and ids:
        there = set(order)
        order = [i for i in ids if i in there]
    if len(order) != len(weights):
        raise ValueError("as many weights as vectors are needed")
    if sum(weights) == 0:
        raise ValueError("the weights add up to 0")
    table = vectors.sparkSession.createDataFrame([(i, float(w)) for i, w in zip(order, weights, strict=True)], "id long, w double")
    return list(centroid_table(rows.join(table, "id"), F.col("w")).first()["centroid"])


def centroid_with(center: Sequence[float], n: int, added: Sequence[float]) -> list[float]:
    return [(c * n + x) / (n + 1) for c, x in zip(center, added, strict=True)]


def centroid_without(center: Sequence[float], n: int, removed: Sequence[float]) -> list[float] | None:
    return None if n <= 1 else [(c * n - x) / (n - 1) for c, x in zip(center, removed, strict=True)]


def least_distance(centroids: Sequence[Sequence[float]], metric: str) -> Column:
    """The distance to the nearest of some centroids; infinite for none."""
    if not centroids:
        return F.lit(float("inf"))
    return F.array_min(F.transform(F.array(*[vector(c) for c in centroids]), lambda c: distance(F.col("embedding"), c, metric)))


def ghosts(vectors: DataFrame, threshold: float, centroids: Sequence[Sequence[float]] = (), metric: str | None = None, auto_k: int = 0, seed: int = 0) -> DataFrame:
    """(id, isolation) of vectors farther than threshold from every centroid; without centroids, from those of k-means."""
    metric = metric_or_euclidean(metric)
    centers = list(centroids) or kmeans(vectors, auto_k or 8, metric, seed=seed).centroids
    scored = vectors.select("id", least_distance(centers, metric).alias("isolation"))
    return scored.filter(F.col("isolation") > threshold)


def cosine_to(direction: Sequence[float], clamped: bool = True) -> Column:
    raw = 1 - cosine_distance(F.col("embedding"), vector(direction))
    return F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0)) if clamped else raw


def cone(vectors: DataFrame, direction: Sequence[float], aperture: float) -> DataFrame:
    """(id, cosine, angle) of vectors within aperture (radians) of a direction, its edge included, the nearest first; zero vectors and a
    zero direction match nothing."""
    if not any(direction):
        return vectors.select("id", F.lit(0.0).alias("cosine"), F.lit(0.0).alias("angle")).limit(0)
    inside = vectors.filter(norm(F.col("embedding")) > 0).select("id", cosine_to(direction).alias("cosine")).filter(F.col("cosine") >= math.cos(aperture))
    return inside.withColumn("angle", F.acos("cosine")).orderBy(F.desc("cosine"), "id")


def in_cone(point: Sequence[float], direction: Sequence[float], aperture: float) -> bool:
    p, d = np.asarray(point, float), np.asarray(direction, float)
    scale = np.linalg.norm(p) * np.linalg.norm(d)
    return bool(scale > 0 and p @ d / scale >= math.cos(aperture))


def lerp(a: Sequence[float], b: Sequence[float], t: float) -> list[float]:
    _check(a, b, t)
    return [x + t * (y - x) for x, y in zip(a, b, strict=True)]


def slerp(a: Sequence[float], b: Sequence[float], t: float) -> list[float]:
    """Along the arc between two unit vectors; inputs aren't normalised, and near-parallel ones go straight."""
    _check(a, b, t)
    omega = math.acos(min(max(float(np.dot(a, b)), -1.0), 1.0))
    if abs(omega) < 1e-6:
        return lerp(a, b, t)
    s = math.sin(omega)
    return [math.sin((1 - t) * omega) / s * x + math.sin(t * omega) / s * y for x, y in zip(a, b, strict=True)]


def _check(a, b, t) -> None:
    if len(a) != len(b):
        raise ValueError("vectors of different dimensions")
    if not 0 <= t <= 1:
        raise ValueError("t must be from 0 to 1")


def sequence(a: Sequence[float], b: Sequence[float], n: int, method: str = "lerp") -> list[list[float]]:
    """n points from a to b, both included; one point is a."""
    f = slerp if method == "slerp" else lerp
    return [f(a, b, i / (n - 1) if n > 1 else 0.0) for i in range(n)]


def interpolated(pairs: DataFrame, t: float) -> DataFrame:
    """pairs(id, a, b) to (id, point), on a straight line, for whole tables."""
    if not 0 <= t <= 1:
        raise ValueError("t must be from 0 to 1")
    return pairs.select("id", F.zip_with("a", "b", lambda x, y: x.cast("double") + (y.cast("double") - x.cast("double")) * t).alias("point"))


def drift(first: DataFrame, second: DataFrame, metric: str | None = None, threshold: float = 0.0) -> DataFrame:
    """One row: centroid_shift, mean_distance_1, mean_distance_2, spread_change (1 if the first is 0), has_drifted."""
    metric = metric_or_euclidean(metric)
    c1, c2 = centroid_table(first).select(F.col("centroid").alias("c1")), centroid_table(second).select(F.col("centroid").alias("c2"))
    # both have one row
    m1 = first.crossJoin(F.broadcast(c1)).agg(F.avg(distance(F.col("embedding"), F.col("c1"), metric)).alias("mean_distance_1"))
    m2 = second.crossJoin(F.broadcast(c2)).agg(F.avg(distance(F.col("embedding"), F.col("c2"), metric)).alias("mean_distance_2"))
    shift = c1.crossJoin(c2).select(distance(F.col("c1"), F.col("c2"), metric).alias("centroid_shift"))
    row = shift.crossJoin(m1).crossJoin(m2)
    spread = F.when(F.col("mean_distance_1") == 0, F.lit(1.0)).otherwise(F.col("mean_distance_2") / F.col("mean_distance_1"))
    return row.withColumn("spread_change", spread).withColumn("has_drifted", F.lit(threshold > 0) & (F.col("centroid_shift") > threshold))


class Clusters:
    def __init__(self, centroids: list[list[float]], assignments: DataFrame, iterations: int, converged: bool):
        self.centroids, self.assignments, self.iterations, self.converged = centroids, assignments, iterations, converged


def assigned(vectors: DataFrame, centroids: Sequence[Sequence[float]], metric: str) -> DataFrame:
    """(id, cluster, distance) to the nearest centroid; ties go to the lower number."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            d = pairwise(c, matrix(batch.column(1), c.shape[1]), metric)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "cluster": d.argmin(0).astype(np.int32), "distance": d.min(0)})

    return vectors.select(F.col("id").cast("long"), "embedding").mapInArrow(run, "id long, cluster int, distance double")


def _sums(vectors: DataFrame, centroids: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Each cluster's sum and count: one small row per task and cluster."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, counts = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), c.shape[1])
            near = pairwise(c, x, metric).argmin(0)
            np.add.at(sums, near, x)
            counts += np.bincount(near, minlength=len(c))
        yield pa.RecordBatch.from_pydict({"cluster": np.arange(len(c)), "n": counts, "total": sums.tolist()})

    rows = vectors.select("embedding").mapInArrow(run, "cluster long, n long, total array<double>")
    flat = rows.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for r in flat:
        sums[r["cluster"], r["at"]], counts[r["cluster"]] = r["x"], r["n"]
    return sums, counts


def _starts(rows: DataFrame, k: int, metric: str, seed: int) -> np.ndarray:
    """k vectors, or all if there are fewer, each drawn by its squared distance to the nearest drawn before."""
    pool = rows.select("id", "embedding").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FEW + 1).toArrow()
    if k <= 0 or not pool.num_rows:
        return np.zeros((0, 0))
    if pool.num_rows > FEW:
        passes = _Passes(rows.select("id", "embedding"), "id", lambda near, x, picked: np.minimum(near, pairwise(picked[None], x, metric)[0] ** 2), math.inf)
        out: list = []
        while len(out) < k:
            # the least of exponential variables whose rates are the weights falls on each row by its weight; rows of no weight come last
            def drawn(x: np.ndarray, near: np.ndarray, o: np.ndarray, n: int = len(out)) -> np.ndarray:
                weight = near if n else np.ones(len(near))
                mixed = (o.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed % 2**32 << 32 | n)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
                u = ((mixed ^ mixed >> np.uint64(31)) >> np.uint64(11)).astype(float) + 0.5
                return np.where(weight > 0, np.log(u / 2**53) / np.where(weight > 0, weight, 1), -1e308)

            row = passes.best(drawn)
            if row is None:
                break
            out.append(row["embedding"])
            passes.take(row)
        return np.array(out, float)
    k = min(k, pool.num_rows)
    x = matrix(pool.column(1), len(pool.column(1)[0]))
    rng = np.random.default_rng(seed)
    starts = [int(rng.integers(len(x)))]
    near = pairwise(x[starts], x, metric)[0] ** 2
    while len(starts) < k:
        total = near.sum()
        pick = int(rng.choice(len(x), p=near / total)) if total > 0 else next(i for i in range(len(x)) if i not in starts)
        starts.append(pick)
        near = np.minimum(near, pairwise(x[[pick]], x, metric)[0] ** 2)
    return x[starts].copy()


def kmeans(vectors: DataFrame, k: int, metric: str | None = None, most: int = 100, tolerance: float = 1e-4, seed: int = 0) -> Clusters:
    """Lloyd's algorithm from seeded k-means++ starts. An empty cluster keeps its centroid; it stops when no centroid moves by the
    tolerance. k is cut to the number of vectors; k = 0 gives no cluster. Starts are drawn from all vectors: in the driver up to FEW, else by
    one pass for each."""
    metric = metric_or_euclidean(metric)
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("embedding").isNotNull())
    centers = _starts(rows, k, metric, seed)
    if not len(centers):
        return Clusters([], spark.createDataFrame([], "id long, cluster int, distance double"), 0, True)
    k = len(centers)
    converged, step = False, 0
    rows.persist()
    for step in range(1, most + 1):
        sums, counts = _sums(rows, centers, metric)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        moved = max(float(pairwise(new[[i]], centers[[i]], metric)[0, 0]) for i in range(k))
        centers = new
        if moved < tolerance:
            converged = True
            break
    rows.unpersist()
    return Clusters(centers.tolist(), assigned(rows, centers, metric), step, converged)


class Components:
    def __init__(self, mean: np.ndarray, components: np.ndarray, explained_variance: np.ndarray):
        self.mean, self.components, self.explained_variance = mean, components, explained_variance

    def transform(self, vectors: DataFrame) -> DataFrame:
        """(id, projected): (v - mean) . component for each component."""
        parts = [dot(F.zip_with("embedding", vector(self.mean), lambda x, m: x.cast("double") - m), vector(c)) for c in self.components]
        return vectors.select("id", F.array(*parts).alias("projected"))


def pca(vectors: DataFrame, n_components: int = 0, most: int = 100, tolerance: float = 1e-6) -> Components:
    """Principal components by power iteration from (1, ..., 1) with deflation, over a covariance that tasks add up in parts.

    explained_variance holds the eigenvalues. At least two vectors are needed; 0 components means 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), len(batch.column(0)[0]))
                n += len(x)
                total = x.sum(0) + (0 if total is None else total)
                gram = x.T @ x + (0 if gram is None else gram)
        if n:
            yield pa.RecordBatch.from_pydict({"row": np.arange(-1, len(total)), "n": np.full(len(total) + 1, n), "x": [total.tolist(), *gram.tolist()]})

    rows = vectors.select("embedding").filter("embedding is not null").mapInArrow(run, "row long, n long, x array<double>")
    flat = rows.select("row", "n", F.posexplode("x").alias("at", "x")).groupBy("row", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # dimension squared
    n = max((r["n"] for r in flat), default=0)
    if n < 2:
        raise ValueError("principal components need two vectors")
    d = 1 + max(r["at"] for r in flat)
    table = np.zeros((d + 1, d))
    for r in flat:
        table[r["row"] + 1, r["at"]] = r["x"]
    mean = table[0] / n
    covariance = (table[1:] - n * np.outer(mean, mean)) / (n - 1)
    components, values = [], []
    for _ in range(min(n_components or 2, d)):
        v = np.full(d, 1 / math.sqrt(d))
        for _ in range(most):
            w = covariance @ v
            size = np.linalg.norm(w)
            if size < 1e-12:
                break
            w = w / size
            done = np.linalg.norm(w - v) < tolerance
            v = w
            if done:
                break
        value = float(v @ covariance @ v)
        components.append(v)
        values.append(value)
        covariance = covariance - value * np.outer(v, v)
    return Components(mean, np.array(components), np.array(values))


def arithmetic(terms: Sequence[tuple[float, Sequence[float]]], normalize: bool = False) -> list[float]:
    """The weighted sum of vectors, at length 1 if asked; a zero sum stays zero."""
    out = sum(w * np.asarray(v, float) for w, v in terms)
    size = float(np.linalg.norm(out))
    return (out / size if normalize and size > 0 else out).tolist()


def analogy(a: Sequence[float], b: Sequence[float], c: Sequence[float], normalize: bool = False, terms: Sequence[tuple[float, Sequence[float]]] = ()) -> list[float]:
    """a - b + c; terms, if given, come first."""
    if not len(a) == len(b) == len(c):
        raise ValueError("vectors of different dimensions")
    return arithmetic(terms or ((1.0, a), (-1.0, b), (1.0, c)), normalize)


def unit(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", normalized(F.col("embedding")).alias("embedding"))


#: Up to so many candidates a greedy selection runs in the driver; of more, each pick is one pass over all.
FEW = 10_000
#: Picks after which the passes carry on from stored likenesses, and the fewest rows of a block in the search of the farthest pair.
STORED_EVERY, BLOCK_ROWS = 32, 2048
STATE = "o long, id long, embedding array<double>, near double, r long"


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with y, or with the same row of y; the same for equal rows wherever they stand."""
    scale = np.linalg.norm(x, axis=1) * np.linalg.norm(np.atleast_2d(y), axis=1)
    return np.where(scale > 0, (x * y).sum(1) / np.where(scale > 0, scale, 1), 0.0)


def _few(vectors: DataFrame, order_col: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors in order of order_col, or None for more than FEW."""
    rows = vectors.select(F.col(order_col).alias("o"), F.col("id").cast("long"), "embedding").limit(FEW + 1).toArrow()
    if rows.num_rows > FEW:
        return None
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    rows = rows.sort_by("o")
    return rows.column(1).to_numpy(), matrix(rows.column(2), len(rows.column(2)[0]))


class _Passes:
    """Greedy picks from any number of rows: a pass folds what was picked into each row's near and takes the row of the largest score; ties go to
    the smaller o, which holds whole numbers."""

    def __init__(self, vectors: DataFrame, order_col: str, fold, start: float):
        """fold(near, x, picked) is the new near of the rows x."""
        o = F.coalesce(F.col(order_col).cast("long"), F.lit(2**63 - 1))
        rows = vectors.select(o.alias("o"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(start).alias("near"))
        # stored, as row numbers must not change between passes
        self.rows, self.fold, self.recent = cut(rows.withColumn("r", F.monotonically_increasing_id())), fold, []

    def take(self, row) -> None:
        self.recent.append((row["r"], np.asarray(row["embedding"], float)))

    def _folded(self):
        fold, recent = self.fold, self.recent

        def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            x = matrix(batch.column(2), len(batch.column(2)[0]))
            near = batch.column(3).to_numpy()
            for _, picked in recent:
                near = fold(near, x, picked)
            return x, near

        return of

    def best(self, score):
        """The row of the largest score(x, near, o) with that score, or None; a score that is no number is never taken."""
        if len(self.recent) >= STORED_EVERY:
            of = self._folded()

            def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        yield batch.set_column(3, "near", pa.array(of(batch)[1], pa.float64()))

            rows = self.rows.filter(~F.col("r").isin([r for r, _ in self.recent])).mapInArrow(stored, STATE)
            self.rows, self.recent = cut(rows), []
        of, taken = self._folded(), np.array([r for r, _ in self.recent], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    r = batch.column(4).to_numpy()
                    got = score(*of(batch), batch.column(0).to_numpy())
                    got = np.where(np.isnan(got) | np.isin(r, taken), -np.inf, got)
                    if (top := got.max()) > -np.inf:
                        k = np.flatnonzero(got == top)
                        o = batch.column(0).to_numpy()[k]
                        k = k[np.lexsort((r[k], o))[0]]
                        yield batch.slice(int(k), 1).append_column("score", pa.array([float(top)]))

        return self.rows.mapInArrow(run, f"{STATE}, score double").orderBy(F.desc("score"), "o", "r").first()


def _most_alike(near: np.ndarray, x: np.ndarray, picked: np.ndarray) -> np.ndarray:
    return np.fmax(near, _cosines(x, picked))


def _directions(x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Rows at length 1 in single precision, zeros as they are, and whether all are numbers."""
    with np.errstate(all="ignore"):
        size = np.linalg.norm(x, axis=1)
        return (x / np.where(size > 0, size, 1)[:, None]).astype(np.float32), bool(np.isfinite(size).all())


def _least_alike(a: tuple, b: tuple, same: bool, found: tuple | None) -> tuple | None:
    """found, or the pair (cosine, o1, r1, o2, r2) of a row of a and one of b that comes before it; a and b hold (o, r, x), and of the same
    block each pair counts once.

    Products in single precision tell which pairs can be the least; these are measured each by itself.
    """
    error = (a[2].shape[1] + 8) * 2.0**-22
    for i in range(0, len(a[0]), TILE):
        one, sane = _directions(a[2][i : i + TILE])
        for j in range(0, len(b[0]), PIECE):
            two, whole = _directions(b[2][j : j + PIECE])
            with np.errstate(all="ignore"):
                c = one @ two.T
            if not (sane and whole):
                c[np.isnan(c)] = np.inf  # never less alike than others
            if same:
                c[np.arange(i, i + len(one))[:, None] >= np.arange(j, j + len(two))[None, :]] = np.nan
            if np.isnan(c).all():
                continue
            least = float(np.nanmin(c)) + error if found is None else min(float(np.nanmin(c)) + error, found[0])
            hits = np.flatnonzero(c <= np.float32(least + error) + np.float32(1e-6))
            for at in range(0, len(hits), PAIRS):
                m, n = np.divmod(hits[at : at + PAIRS], len(two))
                m, n = m + i, n + j
                with np.errstate(all="ignore"):
                    cosine = _cosines(a[2][m], b[2][n])
                cosine[np.isnan(cosine)] = np.inf
                oa, ob, ra, rb = a[0][m], b[0][n], a[1][m], b[1][n]
                later = (oa > ob) | (oa == ob) & (ra > rb)
                keys = np.where(later, ob, oa), np.where(later, rb, ra), np.where(later, oa, ob), np.where(later, ra, rb)
                k = np.lexsort((*keys[::-1], cosine))[0]
                this = (float(cosine[k]), *(int(y[k]) for y in keys))
                found = this if found is None else min(found, this)
    return found


def _farthest_pair(rows: DataFrame):
    """The two rows of STATE least alike, the earlier first; ties go to the earlier. Blocks of rows meet each other once: a task holds one while
    half of the others come by."""
    spark, (total, dimension) = rows.sparkSession, rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    most = max(1, BLOCK_BYTES // (8 * max(dimension, 1)))
    n = max(math.ceil(total / most), min(2 * spark.sparkContext.defaultParallelism, math.ceil(total / BLOCK_ROWS)))

    def pack(table: pa.Table) -> pa.Table:
        held = [np.ascontiguousarray(y).tobytes() for y in (table.column(1).to_numpy(), table.column(2).to_numpy(), matrix(table.column(3), dimension))]
        return pa.table({"b": table.column(0)[:1], "o": [held[0]], "r": [held[1]], "x": [held[2]]})

    dealt = rows.select(F.pmod(F.xxhash64("r"), F.lit(n)).cast("int").alias("b"), "o", "r", "embedding")
    blocks = dealt.groupBy("b").applyInArrow(pack, "b int, o binary, r binary, x binary")
    # block b meets those up to half of the way round before it, and itself
    ahead = F.sequence(F.lit(0), F.when((F.lit(n) % 2 == 0) & (F.col("b") < n // 2), F.lit(max(n // 2 - 1, 0))).otherwise(F.lit(n // 2)))
    pairs = blocks.select(F.explode(ahead).alias("d"), "b", "o", "r", "x").select(F.pmod(F.col("b") - F.col("d"), F.lit(n)).alias("a"), "d", "o", "r", "x")
    met = pairs.repartitionById(n, "a").sortWithinPartitions("a", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, found = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                a, d = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                o, r, x = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((2, np.int64), (3, np.int64), (4, float)))
                own = o, r, x.reshape(len(o), -1)
                if a != at:
                    at, mine = a, None
                if d == 0:
                    mine = tuple(y.copy() for y in own)
                if mine is not None:
                    found = _least_alike(mine, own, d == 0, found)
        if found is not None:
            yield pa.RecordBatch.from_pydict({name: [v] for name, v in zip(("c", "o1", "r1", "o2", "r2"), found, strict=True)})

    pair = met.mapInArrow(run, "c double, o1 long, r1 long, o2 long, r2 long").orderBy("c", "o1", "r1", "o2", "r2").first()
    both = {row["r"]: row for row in rows.filter(F.col("r").isin([pair["r1"], pair["r2"]])).collect()}
    return both[pair["r1"]], both[pair["r2"]]


def diverse(vectors: DataFrame, query: Sequence[float], k: int, balance: float, order_col: str = "id") -> DataFrame:
    """(pos, id, score): maximal marginal relevance, balance * relevance - (1 - balance) * likeness to what is chosen, by cosine; ties go to the
    earlier candidate. Takes any number of candidates."""
    balance, query = min(max(balance, 0.0), 1.0), np.asarray(query, float)
    out: list[tuple[int, int, float]] = []
    few = _few(vectors, order_col)
    if few is None:
        passes = _Passes(vectors, order_col, _most_alike, -math.inf)
        while len(out) < k:
            first = not out
            row = passes.best(lambda x, near, _: balance * _cosines(x, query) - (1 - balance) * (0.0 if first else near))  # noqa: B023
            if row is None:
                break
            out.append((len(out), row["id"], row["score"]))
            passes.take(row)
        return vectors.sparkSession.createDataFrame(out, "pos int, id long, score double")
    ids, x = few
    relevance = _cosines(x, query) if len(x) else np.zeros(0)
    likeness, left = np.full(len(ids), -np.inf), np.ones(len(ids), bool)
    while left.any() and len(out) < k:
        score = np.where(left, balance * relevance - (1 - balance) * (likeness if out else 0.0), -np.inf)
        i = int(score.argmax())
        out.append((len(out), int(ids[i]), float(score[i])))
        left[i] = False
        likeness = np.maximum(likeness, _cosines(x, x[i]))
    return vectors.sparkSession.createDataFrame(out, "pos int, id long, score double")


def spread_out(vectors: DataFrame, k: int, order_col: str = "id") -> DataFrame:
    """(pos, id): the two least alike, then always the one least like its nearest chosen; k = 1 gives the first. Takes any number of
    candidates; the two are searched among all pairs."""
    few = _few(vectors, order_col)
    if few is None:
        found = []
        if k > 0:
            passes = _Passes(vectors, order_col, _most_alike, -math.inf)
            if k == 1:
                found = [passes.rows.orderBy("o", "r").first()]
            else:
                found = list(_farthest_pair(passes.rows))
                for row in found:
                    passes.take(row)
            while len(found) < k and (row := passes.best(lambda x, near, _: -near)) is not None:
                found.append(row)
                passes.take(row)
        return vectors.sparkSession.createDataFrame([(n, row["id"]) for n, row in enumerate(found)], "pos int, id long")
    ids, x = few
    picks: list[int] = []
    if k == 1 and len(ids):
        picks = [0]
    elif k > 1 and len(ids):
        least = (math.inf, 0, 0)
        for i in range(len(x) - 1):
            c = _cosines(x[i + 1 :], x[i])
            j = int(c.argmin())
            if c[j] < least[0]:
                least = (float(c[j]), i, i + 1 + j)
        picks = [0] if len(ids) == 1 else [least[1], least[2]]
        near = np.max([_cosines(x, x[i]) for i in picks], axis=0)
        while len(picks) < min(k, len(ids)):
            near[picks] = np.inf
            i = int(near.argmin())
            picks.append(i)
            near = np.maximum(near, _cosines(x, x[i]))
    return vectors.sparkSession.createDataFrame([(n, int(ids[i])) for n, i in enumerate(picks)], "pos int, id long")
