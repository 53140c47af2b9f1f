"""Exact k-nearest-neighbour search.

Many queries at once are one pass over the vectors: queries are a bounded matrix that each task multiplies with its Arrow batches,
keeping k candidates a query, so only tasks x queries x k rows are shuffled. More queries than fit are taken in blocks. A single query
is an expression and a TakeOrderedAndProject.

Products in single precision only tell which vectors may be among the k nearest, with a bound of their error; these are measured in double
precision, each pair by itself, so that equal vectors have equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distance import distance, known, pairwise, vector
from quillon.functions.filters import Filter, compiled, selectivity

#: The most bytes of query vectors that go to every executor at a time.
QUERY_BYTES = 8 << 20
#: Bytes of vectors in a block, where more queries meet the vectors block by block, and the most blocks of vectors that a task reads.
BLOCK_BYTES, MOST_BLOCKS = 8 << 20, 32
#: Queries and vectors that are multiplied at a time, vectors at first, and pairs that are measured at a time.
TILE, PIECE, FIRST, PAIRS = 256, 8192, 1024, 65_536
MOST_EF = 10_000


@dataclass(frozen=True)
class Quantization:
    """Search over codes: rescore the best k * oversampling exactly; ignore searches the vectors themselves."""

    rescore: bool = True
    oversampling: float = 3.0
    ignore: bool = False

    def factor(self) -> float:
        return self.oversampling if self.oversampling > 0 else 3.0


def check_ef(ef: int | None) -> None:
    """ef bounds an approximate index's effort; exact search accepts and ignores it."""
    if ef is not None and (ef < 0 or ef > MOST_EF):
        raise ValueError(f"ef must be at most {MOST_EF}")


def search(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: Filter | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score, rank) of the k nearest vectors that pass where; ties go to the smaller id, NaN comes last."""
    kept = vectors.filter(compiled(where, vectors.schema)).filter(F.col(vec_col).isNotNull())
    scored = kept.select(F.col(id_col).alias("id"), distance(F.col(vec_col), vector(query), metric).alias("score"))
    top = scored.orderBy("score", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))  # of k rows


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    out = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    if len(out) != len(column) * dimension:
        raise ValueError(f"a vector that doesn't have {dimension} entries")
    return out.reshape(-1, dimension)


def exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of q to the same row of v."""
    if metric == "manhattan":
        return np.abs(v - q).sum(1)
    if metric == "euclidean":
        return np.sqrt(((q - v) ** 2).sum(1))
    products = (q * v).sum(1)
    if metric == "dot_product":
        return -products
    scale = np.sqrt((q * q).sum(1) * (v * v).sum(1))
    return np.where(scale == 0, 1.0, 1 - products / np.where(scale == 0, 1, scale))


class _Single:
    """Vectors in single precision, with what bounds the error of their products; plain() if that holds."""

    def __init__(self, x: np.ndarray, metric: str):
        with np.errstate(all="ignore"):
            self.size = np.sqrt((x * x).sum(1))
            self.sane = bool(np.all((self.size == 0) | (self.size > 1e-15) & (self.size < 1e15)))
            if metric == "cosine":
                x = x / np.where(self.size > 0, self.size, 1)[:, None]
            self.x = x.astype(np.float32)
        self.most = float(self.size.max(initial=0.0))


class Nearest:
    """The k nearest vectors of each of some queries among the vectors that come by; ties go to the smaller id, NaN comes last."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = np.asarray(queries, np.float64), k, metric
        self.tiles = [slice(at, at + TILE) for at in range(0, len(self.q), TILE)]
        self.single = [_Single(self.q[t], metric) for t in self.tiles]
        self.found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in self.tiles]  # place in the tile, score, id
        self.limit = [np.full(len(s.size), np.inf) for s in self.single]

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        at, most = 0, max(FIRST, min(PIECE, (4 << 20) // max(vectors.shape[1], 1)))
        while at < len(ids):
            step = FIRST if any(np.isinf(x).any() for x in self.limit) else most
            v, own = np.asarray(vectors[at : at + step], np.float64), ids[at : at + step]
            single = _Single(v, self.metric)
            for n in range(len(self.tiles)):
                self._tile(n, own, v, single)
            at += step

    def _near(self, n: int, v: np.ndarray, single: _Single) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower bounds' stand-ins: (scores, each query's largest error, each query's limit on the same scale)."""
        mine, d, limit = self.single[n], v.shape[1], self.limit[n]
        if self.metric == "manhattan" or not (mine.sane and single.sane):
            with np.errstate(all="ignore"):
                scores = pairwise(self.q[self.tiles[n]], v, self.metric)
            scores[np.isnan(scores)] = np.inf
            return scores, np.where(np.isinf(limit), 0.0, 1e-9 * np.abs(np.where(np.isinf(limit), 0.0, limit)) + 1e-12), limit
        error = (d + 8) * 2.0**-22
        products = mine.x @ single.x.T
        if self.metric == "cosine":
            return np.negative(products, out=products), np.full(len(limit), error), limit - 1
        if self.metric == "dot_product":
            return np.negative(products, out=products), error * mine.size * single.most + 1e-30, limit
        products *= -2
        products += (single.size**2).astype(np.float32)[None, :]
        return products, 2 * error * (mine.size + single.most) ** 2 + 1e-30, limit**2 - mine.size**2

    def _tile(self, n: int, ids: np.ndarray, v: np.ndarray, single: _Single) -> None:
        k = self.k
        scores, error, limit = self._near(n, v, single)
        if scores.shape[1] > k and (open_ := np.flatnonzero(np.isinf(limit))).size:
            limit = limit.copy()
            limit[open_] = np.partition(scores[open_], k - 1, axis=1)[:, k - 1].astype(np.float64) + error[open_]
        with np.errstate(over="ignore"):
            most = (limit + error).astype(scores.dtype)
            if scores.dtype == np.float32:
                most = np.nextafter(most, np.float32(np.inf))
        hits = np.flatnonzero(scores <= most[:, None])
        if not len(hits):
            return
        q, q_at, parts = self.q[self.tiles[n]], self.limit[n], [self.found[n]]
        for at in range(0, len(hits), max(1, PAIRS * 64 // max(v.shape[1], 64))):
            which, place = np.divmod(hits[at : at + max(1, PAIRS * 64 // max(v.shape[1], 64))], len(ids))
            with np.errstate(all="ignore"):
                score = exact(q[which], v[place], self.metric)
            kept = ~(score > q_at[which])
            parts.append((which[kept], score[kept], ids[place[kept]]))
        which, score, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        nan = np.isnan(score)
        order = np.lexsort((own, np.where(nan, 0, score), nan, which))
        which = which[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        order, which, rank = order[rank < k], which[rank < k], rank[rank < k]
        score, own = score[order], own[order]
        self.found[n] = which, score, own
        full = rank == k - 1
        self.limit[n][which[full]] = np.where(np.isnan(score[full]), np.inf, score[full])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score), by query and rank."""
        which = [x[0] + t.start for x, t in zip(self.found, self.tiles, strict=True)]
        if not which:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(which), np.concatenate([x[2] for x in self.found]), np.concatenate([x[1] for x in self.found])


FOUND = "qid long, id long, score double"


def _found(qids: np.ndarray, near: Nearest) -> Iterator[pa.RecordBatch]:
    which, ids, scores = near.rows()
    if len(which):
        yield pa.RecordBatch.from_pydict({"qid": qids[which], "id": ids, "score": scores})


def _block(vectors: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int, metric: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((qids, queries))  # at most QUERY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries = shared.value
        near = Nearest(queries, k, metric)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                near.meet(piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(piece.column(1), queries.shape[1]))
        yield from _found(qids, near)

    return vectors.mapInArrow(run, FOUND)


def packed(rows: DataFrame, n: int, dimension: int, kind: str, name: str) -> DataFrame:
    """rows(id, vector) as n blocks by a hash of the id: (name, ids, x), x in numbers of this kind; blocks without rows are left out."""

    def run(table: pa.Table) -> pa.Table:
        x = matrix(table.column(2), dimension).astype(kind)
        ids = table.column(1).to_numpy().astype(np.int64)
        return pa.table({name: table.column(0)[:1], "ids": [ids.tobytes()], "x": [x.tobytes()]})

    first, second = rows.columns
    dealt = rows.select(F.pmod(F.xxhash64(first), F.lit(n)).cast("int").alias(name), first, second)
    return dealt.groupBy(name).applyInArrow(run, f"{name} int, ids binary, x binary")


def _blocks(queries: DataFrame, vectors: DataFrame, k: int, metric: str, dimension: int, n: int) -> DataFrame:
    """(qid, id, score): the k best of each of n queries among the vectors, or among each of the runs of MOST_BLOCKS blocks.

    A task holds a block of queries and one of vectors at a time; nothing goes through the driver but counts.
    """
    spark, (kind, size) = vectors.sparkSession, ("f4", 4) if dict(queries.dtypes)["q"] == dict(vectors.dtypes)["v"] == "array<float>" else ("f8", 8)
    most = max(1, BLOCK_BYTES // (size * max(dimension, 1)))
    n_one = max(math.ceil(n / most), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / TILE)))
    n_two = max(1, math.ceil(vectors.count() / most))
    runs = math.ceil(n_two / MOST_BLOCKS)
    one, two = packed(queries, n_one, dimension, kind, "a"), packed(vectors, n_two, dimension, kind, "b")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = one.select("a", upto(runs).alias("run"), F.lit(-1).alias("b"), "ids", "x").unionByName(two.select(upto(n_one).alias("a"), F.expr(f"cast(b div {MOST_BLOCKS} AS int)").alias("run"), "b", "ids", "x"))
    dealt = sides.repartitionById(n_one * runs, F.col("a") * runs + F.col("run")).sortWithinPartitions("a", "run", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near, qids = None, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                a, part, b = (batch.column(c)[n].as_py() for c in range(3))
                ids, x = np.frombuffer(batch.column(3)[n].as_buffer(), np.int64), np.frombuffer(batch.column(4)[n].as_buffer(), kind).reshape(-1, dimension)
                if (a, part) != at:
                    if near is not None:
                        yield from _found(qids, near)
                    at, near = (a, part), None
                if b < 0:
                    near, qids = Nearest(x, k, metric), ids.copy()
                elif near is not None:
                    near.meet(ids, x)
        if near is not None:
            yield from _found(qids, near)

    return dealt.mapInArrow(run, FOUND)


def batch_search(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Filter | None = None, id_col: str = "id", vec_col: str = "embedding", query_id: str = "qid", query_vec: str = "query"
) -> DataFrame:
    """(qid, id, score, rank): for each query row the k nearest vectors that pass where, exactly.

    A null query or vector takes no part; no queries or no vectors give no rows. Ties go to the smaller id.
    """
    metric = known(metric)
    kept = vectors.filter(compiled(where, vectors.schema)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("v is not null")
    slim = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_vec).alias("q")).filter("q is not null")
    n, dimension = slim.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    schema = "qid long, id long, score double, rank int"
    if not n or k < 1:
        return vectors.sparkSession.createDataFrame([], schema)
    if n * dimension * 8 <= QUERY_BYTES:
        rows = slim.toArrow()
        out = _block(kept, rows.column(0).to_numpy(), matrix(rows.column(1), dimension), k, metric)
    else:
        out = _blocks(slim, kept, k, metric, dimension, n)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.isnan("score"), "score", "id")))
    return ranked.filter(F.col("rank") <= k)


def oversampling(share: float) -> int:
    """How many times k a search must return before a filter that passes this share."""
    return 20 if share <= 0 else min(max(math.ceil(1 / share), 3), 20)


def filtered_search(
    vectors: DataFrame, query: Sequence[float], k: int, where: Filter | None, strategy: str = "auto", metric: str = "cosine", share: float | None = None, id_col: str = "id", vec_col: str = "embedding"
) -> DataFrame:
    """search under a strategy. pre_filter and auto filter first, which is exact; post_filter searches k times the oversampling
    (at least 3, or by the filter's assumed share) and filters what it found, so that it may return fewer than k. Any other
    name is auto."""
    if strategy != "post_filter" or where is None:
        return search(vectors, query, k, metric, where, id_col, vec_col)
    factor = max(3, oversampling(share)) if share is not None else 3
    found = search(vectors, query, k * factor, metric, None, id_col, vec_col)
    rows = vectors.withColumnRenamed(id_col, "__id") if id_col != "__id" else vectors
    passed = found.join(rows.filter(compiled(where, rows.schema)).select("__id"), F.col("id") == F.col("__id"), "left_semi").drop("rank").orderBy("score", "id").limit(k)
    return passed.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))


def assumed_share(vectors: DataFrame, where: Filter, names: Sequence[str]) -> float:
    """The share of rows that a planner assumes for a filter, from approximate statistics of the named columns."""
    stats = [F.approx_count_distinct(c).alias(f"d_{c}") for c in names] + [F.count(c).alias(f"f_{c}") for c in names]
    row = vectors.agg(F.count(F.lit(1)).alias("n"), *stats).first()
    return selectivity(where, {c: row[f"d_{c}"] for c in names}, {c: row[f"f_{c}"] for c in names}, row["n"])


@dataclass(frozen=True)
class Request:
    """One query of a mixed batch."""

    vectors: DataFrame
    query: Sequence[float]
    k: int
    metric: str = "cosine"
    where: Filter | None = None
    strategy: str = "auto"


def mixed_batch(requests: Sequence[Request]) -> DataFrame:
    """(qid, id, score, rank) of queries that differ in collection, k, filter or strategy; qid is the request's place."""
    groups: dict[tuple, list[int]] = {}
    for n, r in enumerate(requests):
        # requests that filter first and differ in query and k alone read their vectors once
        alone = n if r.strategy == "post_filter" and r.where is not None else -1
        groups.setdefault((id(r.vectors), repr(r.where), r.metric, alone), []).append(n)
    parts = []
    for places in groups.values():
        r = requests[places[0]]
        if len(places) == 1:
            parts.append(filtered_search(r.vectors, r.query, r.k, r.where, r.strategy, r.metric).withColumn("qid", F.lit(places[0]).cast("long")))
            continue
        rows = r.vectors.sparkSession.createDataFrame([(n, [float(x) for x in requests[n].query], requests[n].k) for n in places], "qid long, query array<double>, k int")
        found = batch_search(r.vectors, rows, max(requests[n].k for n in places), r.metric, r.where)
        parts.append(found.join(F.broadcast(rows.select("qid", "k")), "qid").filter("rank <= k").drop("k"))
    if not parts:
        raise ValueError("a batch needs a request")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("qid", "id", "score", "rank")


def with_metadata(found: DataFrame, vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """found with the vectors' other columns."""
    return found.join(vectors.drop(vec_col).withColumnRenamed(id_col, "id"), "id", "left")


GRAPH_EDGES = 10
PENDING = "the collection has changes that optimize() hasn't seen; approximate structures may miss them"


def with_graph(found: DataFrame, sim_edges: DataFrame, most: int = 0, threshold: float = 0.0, default: float = 0.7, overrides: DataFrame | None = None) -> DataFrame:
    """found(id, ...) with graph_edges: each result's edges (target, similarity) of the similarity graph, the most similar first.

    At most ten unless most says otherwise; a threshold of 0 takes each vector's own or the collection's.
    """
    from quillon.operators.simgraph import related

    near = related(sim_edges, found.select("id"), threshold or None, default, most or GRAPH_EDGES, overrides)
    listed = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("dst").alias("target"), "similarity"))).alias("g"))
    edges = F.transform(F.coalesce("g", F.array().cast("array<struct<rank:int,target:bigint,similarity:double>>")), lambda e: F.struct(e["target"].alias("target"), e["similarity"].alias("similarity")))
    return found.join(listed.withColumnRenamed("src", "id"), "id", "left").withColumn("graph_edges", edges).drop("g")


def warning(status: str) -> str | None:
    """What a search over a collection of this status should tell its caller."""
    return PENDING if status == "pending_optimization" else None
