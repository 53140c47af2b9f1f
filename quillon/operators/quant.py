"""Vector codes - scalar (8 bits), product, binary - and inverted cells, with two-stage search over them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distance import distance, known, pairwise, squared_euclidean_distance, vector
from quillon.lineage import in_order
from quillon.operators.knn import Quantization, matrix

LEVELS, CENTROIDS, CELLS, SEED = 255, 256, 256, 42
QUANTILE = 0.99
#: Vectors that a codebook is trained on at most: those of smallest hashed id. Every vector is encoded.
TRAINED_ON = 20_000


@dataclass(frozen=True)
class ScalarCodes:
    """Each dimension's range; a range of 0 counts as 1."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    def _width(self) -> list[float]:
        return [h - a if h != a else 1.0 for a, h in zip(self.low, self.high, strict=True)]

    def encoded(self, column: Column) -> Column:
        """clamp(round((x - low) / range * 255), 0, 255) of each entry."""
        scaled = F.zip_with(column, F.arrays_zip(vector(self.low).alias("a"), vector(self._width()).alias("w")), lambda x, s: (x.cast("double") - s["a"]) / s["w"] * LEVELS)
        return F.transform(scaled, lambda x: F.least(F.greatest(F.round(x), F.lit(0.0)), F.lit(float(LEVELS))).cast("int"))

    def decoded(self, column: Column) -> Column:
        return F.zip_with(column, F.arrays_zip(vector(self.low).alias("a"), vector(self._width()).alias("w")), lambda c, s: c.cast("double") / LEVELS * s["w"] + s["a"])


def train_scalar(vectors: DataFrame, quantile: float | None = None) -> ScalarCodes:
    """Ranges by minimum and maximum, or by the sorted values at (1 - q) / 2 and (1 + q) / 2 of the count; NaN and no vectors are errors."""
    parts = vectors.select(F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    if quantile is None:
        rows = parts.groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max(F.isnan("x")).alias("bad")).orderBy("at").collect()
    else:
        counts = parts.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max(F.isnan("x")).alias("bad")).orderBy("at").collect()  # a row per dimension
        first, wanted = 0, []
        for r in counts:
            n = r["n"]
            wanted += [(r["at"], side, first + at) for side, at in (("low", math.floor((1 - quantile) / 2 * n)), ("high", min(n - 1, math.floor((1 + quantile) / 2 * n))))]
            first += n
        rows = []
        if counts:
            # all entries sorted by dimension and value over all tasks, and the wanted places of that order
            places = vectors.sparkSession.createDataFrame(wanted, "at int, side string, place long")
            found = in_order(parts, "place", "at", "x").join(F.broadcast(places), ["at", "place"]).collect()
            value = {(r["at"], r["side"]): r["x"] for r in found}
            rows = [{"low": value[r["at"], "low"], "high": value[r["at"], "high"], "bad": r["bad"]} for r in counts]
    if not rows:
        raise ValueError("no vectors to train on")
    if any(r["bad"] for r in rows):
        raise ValueError("NaN can't be quantised")
    return ScalarCodes(tuple(r["low"] for r in rows), tuple(r["high"] for r in rows))


def scalar_encode(vectors: DataFrame, codes: ScalarCodes) -> DataFrame:
    return vectors.select("id", codes.encoded(F.col("embedding")).alias("code"))


def scalar_decode(coded: DataFrame, codes: ScalarCodes) -> DataFrame:
    return coded.select("id", codes.decoded(F.col("code")).alias("embedding"))


def scalar_distance(codes: ScalarCodes, a: Column, b: Column, metric: str, both_coded: bool = False) -> Column:
    """Of two codes, or of a vector a and a code b."""
    return distance(codes.decoded(a) if both_coded else a, codes.decoded(b), metric)


def scalar_search(vectors: DataFrame, coded: DataFrame, codes: ScalarCodes, query: Sequence[float], k: int, metric: str = "cosine", options: Quantization | None = None, ef: int = 50) -> DataFrame:
    """(id, score, rank): the best max(k * oversampling, k, ef) by code, rescored exactly unless told not to."""
    options = options or Quantization()
    if options.ignore:
        scored = vectors.select("id", distance(F.col("embedding"), vector(query), metric).alias("score"))
    else:
        width = max(math.ceil(k * options.factor()), k, ef)
        scored = coded.select("id", scalar_distance(codes, vector(query), F.col("code"), metric).alias("score")).orderBy("score", "id").limit(width)
        if options.rescore:
            scored = vectors.join(F.broadcast(scored.select("id")), "id", "left_semi").select("id", distance(F.col("embedding"), vector(query), metric).alias("score"))  # width rows
    return _ranked(scored.orderBy("score", "id").limit(k))


def scalar_search_among(vectors: DataFrame, coded: DataFrame, codes: ScalarCodes, query: Sequence[float], k: int, candidates: DataFrame, metric: str = "cosine", rescore: bool = True) -> DataFrame:
    """Of candidates(id), the best k by code; rescoring only puts these in exact order."""
    near = coded.join(candidates, "id", "left_semi").select("id", scalar_distance(codes, vector(query), F.col("code"), metric).alias("score")).orderBy("score", "id").limit(k)
    if rescore:
        near = vectors.join(F.broadcast(near.select("id")), "id", "left_semi").select("id", distance(F.col("embedding"), vector(query), metric).alias("score"))  # k rows
    return _ranked(near)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))  # of k rows


def codebook(x: np.ndarray, k: int, seed: int, most: int = 50) -> np.ndarray:
    """k-means for quantisers: seeded k-means++; stops when assignments repeat; more centroids than points repeat the last."""
    rng = np.random.default_rng(seed)
    n = min(k, len(x))
    centers = [x[int(rng.integers(len(x)))]]
    near = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < n:
        total = near.sum()
        centers.append(x[int(rng.choice(len(x), p=near / total)) if total > 0 else len(centers) % len(x)])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
    c, last = np.array(centers), None
    for _ in range(most):
        own = pairwise(c, x, "euclidean").argmin(0)
        if last is not None and (own == last).all():
            break
        last = own
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(c))
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return np.concatenate([c, np.repeat(c[-1:], k - len(c), 0)]) if len(c) < k else c


def _sample(vectors: DataFrame, most: int = TRAINED_ON) -> np.ndarray:
    rows = vectors.select("id", "embedding").filter("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    if not rows.num_rows:
        raise ValueError("no vectors to train on")
    return matrix(rows.column(1), len(rows.column(1)[0]))


@dataclass
class ProductCodes:
    """books: parts x centroids x entries of a part."""

    books: np.ndarray

    def encode(self, vectors: DataFrame) -> DataFrame:
        """(id, code): each part's nearest centroid, the lowest of equals."""
        shared = vectors.sparkSession.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            m, _, width = books.shape
            for batch in batches:
                x = matrix(batch.column(1), m * width)
                code = np.stack([pairwise(books[p], x[:, p * width : (p + 1) * width], "euclidean").argmin(0) for p in range(m)], 1)
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "code": pa.array(code.astype(np.int32).tolist(), pa.list_(pa.int32()))})

        return vectors.select(F.col("id").cast("long"), "embedding").mapInArrow(run, "id long, code array<int>")

    def decode(self, coded: DataFrame) -> DataFrame:
        books = self.books

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "embedding": [np.concatenate([books[p, c] for p, c in enumerate(code)]).tolist() for code in pdf["code"]]})

        return coded.select("id", "code").mapInPandas(run, "id long, embedding array<double>")

    def table(self, query: Sequence[float], metric: str = "euclidean") -> np.ndarray:
        """parts x centroids: squared distances to the query's parts, or negated products."""
        m, _, width = self.books.shape
        q = np.asarray(query, float).reshape(m, 1, width)
        return -(self.books * q).sum(2) if known(metric) == "dot_product" else ((self.books - q) ** 2).sum(2)

    def search(self, coded: DataFrame, query: Sequence[float], k: int, metric: str = "euclidean") -> DataFrame:
        flat = F.array(*[F.lit(float(v)) for v in self.table(query, metric).reshape(-1)])
        n = self.books.shape[1]
        parts = F.transform(F.col("code"), lambda c, p: F.element_at(F.col("__t"), (p * n + c + 1).cast("int")))
        scored = coded.withColumn("__t", flat).select("id", F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("score"))
        return _ranked(scored.orderBy("score", "id").limit(k))


def train_product(vectors: DataFrame, parts: int, centroids: int = CENTROIDS, seed: int = SEED) -> ProductCodes:
    x = _sample(vectors)
    if x.shape[1] % parts:
        raise ValueError("the dimension must be a multiple of the parts")
    width = x.shape[1] // parts
    return ProductCodes(np.stack([codebook(x[:, p * width : (p + 1) * width], centroids, seed + p) for p in range(parts)]))


def train_binary(vectors: DataFrame) -> list[float]:
    """Each dimension's mean."""
    return [r["m"] for r in vectors.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("at").collect()]


def binary_encode(vectors: DataFrame, thresholds: Sequence[float] | None = None) -> DataFrame:
    """(id, code): a bit for each entry at or over its threshold (0 untrained), in 64-bit words, the lowest bit first."""

    def words(column: Column, t: Column) -> Column:
        bits = F.zip_with(column, t, lambda x, y: (x.cast("double") >= y).cast("long"))
        n = F.size(column)
        return F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")),
            lambda w: F.aggregate(F.sequence(F.lit(0), F.least(F.lit(63), n - w * 64 - 1)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(F.call_function("shiftleft", F.element_at(bits, w * 64 + b + 1), b))),
        )

    t = vector(thresholds) if thresholds is not None else F.transform(F.col("embedding"), lambda x: F.lit(0.0))
    return vectors.filter(F.size("embedding") > 0).select("id", words(F.col("embedding"), t).alias("code"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_share(a: Column, b: Column, dimension: int) -> Column:
    return hamming(a, b) / dimension


def hamming_cosine(a: Column, b: Column, dimension: int) -> Column:
    """An estimate of the cosine distance."""
    return 2 * hamming(a, b) / dimension


def binary_search(coded: DataFrame, query_code: Sequence[int], k: int) -> DataFrame:
    code = F.array(*[F.lit(int(w)).cast("long") for w in query_code])
    return _ranked(coded.select("id", hamming(F.col("code"), code).cast("double").alias("score")).orderBy("score", "id").limit(k))


@dataclass
class Cells:
    """Inverted cells: each vector belongs to its nearest centroid."""

    centroids: np.ndarray

    def add(self, vectors: DataFrame) -> DataFrame:
        """vectors with their cell; written with partitionBy("cell"), a search reads its probes only."""
        shared = vectors.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                x = matrix(batch.column(1), c.shape[1])
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "embedding": batch.column(1), "cell": pairwise(c, x, "euclidean").argmin(0).astype(np.int32)})

        return vectors.select(F.col("id").cast("long"), "embedding").mapInArrow(run, "id long, embedding array<float>, cell int")

    def probes(self, query: Sequence[float], n: int | None = None) -> list[int]:
        """The n nearest cells; by default the root of their number, rounded up."""
        n = math.ceil(math.sqrt(len(self.centroids))) if n is None else n
        d = pairwise(np.asarray([query], float), self.centroids, "euclidean")[0]
        return np.argsort(d, kind="stable")[: min(max(n, 1), len(self.centroids))].tolist()

    def search(self, celled: DataFrame, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """(id, score, rank) by squared euclidean distance within the probed cells, which the scan prunes to."""
        rows = celled.filter(F.col("cell").isin(self.probes(query, probes)))
        return _ranked(rows.select("id", squared_euclidean_distance(F.col("embedding"), vector(query)).alias("score")).orderBy("score", "id").limit(k))

    def residual_search(self, celled: DataFrame, residual_codes: DataFrame, codes: ProductCodes, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """The same over product codes of residuals(id, cell, code)."""
        cells = self.probes(query, probes)
        parts = [codes.search(residual_codes.filter(F.col("cell") == c), (np.asarray(query) - self.centroids[c]).tolist(), k).drop("rank") for c in cells]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return _ranked(out.orderBy("score", "id").limit(k))

    def residuals(self, celled: DataFrame) -> DataFrame:
        """(id, cell, embedding): each vector less its cell's centroid."""
        rows = celled.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cell int, center array<double>")  # at most CELLS rows
        return celled.join(F.broadcast(rows), "cell").select("id", "cell", F.zip_with("embedding", "center", lambda x, c: (x.cast("double") - c).cast("float")).alias("embedding"))


def train_cells(vectors: DataFrame, cells: int = CELLS, seed: int = SEED) -> Cells:
    x = _sample(vectors)
    return Cells(codebook(x, min(cells, CELLS, len(x)), seed))


