"""Hybrid query plans: steps over an ordered frontier of nodes, edges or paths, compiled to DataFrames.

Order is data: a frontier of nodes is (pos, id), of edges (pos, id), of paths (pos, nodes). Steps are joins, filters and aggregates, and
positions come from (parent's position, out before in, edge id). Walks are loops over levels that end when a level is empty.
"""

from __future__ import annotations

import asyncio
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distance import distance, vector
from quillon.functions.predicates import Predicate, compiled
from quillon.functions.weights import Temporal, Weight, cost, effective_weight, valid
from quillon.lineage import cut, in_order
from quillon.operators import vmath
from quillon.operators.graph import Graph, as_edge_rows, direction_of, incident, neighbours, no_structure, node_edges, with_degrees
from quillon.operators.knn import search

RRF_K = 60.0
#: Up to so many nodes, a frontier's edges are picked by its ids as values, and by ids that go to every executor.
AS_VALUES, AS_BROADCAST = 1000, 1_000_000
#: Ids of a frontier are told apart by spans of 2**SPAN, unless these are more than MOST_SPANS.
SPAN, MOST_SPANS = 16, 4096
MODES = ("vector_only", "auto_similarity", "hybrid")


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    name: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Rrf:
    """Reciprocal rank fusion; all defaults means none, and edge_weight alone doesn't turn it on."""

    k: float = 0.0
    max_hops: int = 0
    relations: tuple[str, ...] = ()
    mentions: str = "mentions"
    hub_damping: float = 0.0
    pool: int = 0
    edge_weight: Weight | None = None

    def off(self) -> bool:
        return not (self.k or self.max_hops or self.relations or self.hub_damping or self.pool)


def _numbered(df: DataFrame, *order) -> DataFrame:
    """pos from 0 in an order. A frontier is one ordered list, so one task numbers it."""
    return df.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def from_frontier(near: DataFrame, frontier: DataFrame) -> DataFrame:
    """near(node, ...) without what can't start at frontier(id), a kept table. Filters on node go down to where edges are read, before they are
    joined and grouped, so that a step's cost is that of the edges it takes; of a large frontier only spans of ids are told apart."""
    ids = frontier.select(F.col("id").alias("__at")).distinct()
    values = [r[0] for r in ids.limit(AS_VALUES + 1).collect()]
    if len(values) <= AS_VALUES:
        return near.filter(F.col("node").isin(values))
    spans = [r[0] for r in ids.select(F.shiftright("__at", SPAN)).distinct().limit(MOST_SPANS + 1).collect()]
    if len(spans) <= MOST_SPANS:
        near = near.filter(F.shiftright("node", SPAN).isin(spans))
    if ids.limit(AS_BROADCAST + 1).count() <= AS_BROADCAST:
        near = near.join(F.broadcast(ids), F.col("node") == F.col("__at"), "left_semi")
    return near


class Query:
    """Builds and runs a plan over one collection."""

    kind = "nodes"

    def __init__(self, graph: Graph, vectors: DataFrame, metric: str = "cosine", mode: str = "hybrid", steps: tuple[Step, ...] = (), now_ms: int | None = None):
        self.graph, self.vectors, self.metric, self.mode, self.steps = graph, vectors, metric, mode, steps
        self.now_ms = now_ms

    def _then(self, kind: type, name: str, **args):
        out = kind(self.graph, self.vectors, self.metric, self.mode, (*self.steps, Step(name, args)), self.now_ms)
        return out

    def limit(self, n: int):
        return self._then(type(self), "limit", n=n)

    def now(self, now_ms: int):
        return type(self)(self.graph, self.vectors, self.metric, self.mode, self.steps, now_ms)

    def run(self) -> DataFrame:
        """The frontier that the plan ends with."""
        if not self.steps:
            raise PlanError("an empty plan")
        return Run(self).run(self.steps)[1]

    async def arun(self) -> DataFrame:
        """run for callers that mustn't wait: the plan's jobs are started from another thread."""
        return await asyncio.to_thread(self.run)


class NodeQuery(Query):
    def vector_similar(self, query: Sequence[float], k: int, ef: int | None = None) -> NodeQuery:
        return self._then(NodeQuery, "vector_similar", query=list(query), k=k, ef=ef)

    def from_nodes(self, ids: Sequence[int]) -> NodeQuery:
        return self._then(NodeQuery, "from_nodes", ids=list(ids))

    def scan(self, entities: bool | None = None, label: str | None = None, predicate: Predicate | None = None) -> NodeQuery:
        return self._then(NodeQuery, "scan", entities=entities, label=label, predicate=predicate)

    def traverse(self, edge_type: str | None = None, direction: str = "outgoing", temporal: Temporal | None = None) -> NodeQuery:
        return self._then(NodeQuery, "traverse", edge_type=edge_type, direction=direction, temporal=temporal)

    def k_hop(self, most: int, edge_type: str | None = None, predicate: Predicate | None = None, temporal: Temporal | None = None, weight: Weight | None = None, order_by_weight: bool = False) -> NodeQuery:
        return self._then(NodeQuery, "k_hop", most=most, edge_type=edge_type, predicate=predicate, temporal=temporal, weight=weight if order_by_weight else None)

    def shortest_path(self, target: int, edge_types: Sequence[str] = (), weight: Weight | None = None) -> PathQuery:
        return self._then(PathQuery, "shortest_path", target=target, edge_types=tuple(edge_types), weight=weight)

    def mutual_neighbours(self, other: NodeQuery) -> NodeQuery:
        return self._then(NodeQuery, "mutual", other=other)

    def intersect(self, other: NodeQuery) -> NodeQuery:
        return self._then(NodeQuery, "intersect", other=other)

    def union(self, other: NodeQuery) -> NodeQuery:
        return self._then(NodeQuery, "union", other=other)

    def except_(self, other: NodeQuery) -> NodeQuery:
        """The frontier without other's nodes."""
        return self._then(NodeQuery, "except", other=other)

    def filter(self, predicate: Predicate) -> NodeQuery:
        return self._then(NodeQuery, "filter", predicate=predicate)

    def collect_edges(self, edge_type: str | None = None, direction: str = "outgoing") -> EdgeQuery:
        return self._then(EdgeQuery, "collect_edges", edge_type=edge_type, direction=direction)

    def vector_rank(self, query: Sequence[float], k: int, on_missing: str = "skip", predicate: Predicate | None = None) -> NodeQuery:
        return self._then(NodeQuery, "vector_rank", query=list(query), k=k, on_missing=on_missing, predicate=predicate)

    def analogy(self, a, b, c, k: int, on_missing: str = "skip") -> NodeQuery:
        return self._then(NodeQuery, "vector_rank", query=vmath.analogy(a, b, c), k=k, on_missing=on_missing, predicate=None)

    def interpolate(self, a, b, t: float, k: int, on_missing: str = "skip") -> NodeQuery:
        return self._then(NodeQuery, "vector_rank", query=vmath.slerp(a, b, t), k=k, on_missing=on_missing, predicate=None)

    def centroid(self, k: int, on_missing: str = "skip") -> NodeQuery:
        return self._then(NodeQuery, "centroid", k=k, on_missing=on_missing)

    def diversity(self, query, k: int, balance: float, on_missing: str = "skip") -> NodeQuery:
        return self._then(NodeQuery, "diversity", query=list(query), k=k, balance=balance, on_missing=on_missing)

    def cone(self, direction, aperture: float, k: int, on_missing: str = "skip") -> NodeQuery:
        return self._then(NodeQuery, "cone", direction=list(direction), aperture=aperture, k=k, on_missing=on_missing)

    def isolation(self, centroids, k: int, on_missing: str = "skip") -> NodeQuery:
        return self._then(NodeQuery, "isolation", centroids=centroids, k=k, on_missing=on_missing)

    def return_nodes(self) -> DataFrame:
        """(pos, id, kind, label, properties); a node without a row of its own has nulls."""
        rows = self.graph.nodes.select("id", "kind", "label", "properties")
        return self.run().join(rows, "id", "left").select("pos", "id", "kind", "label", "properties")

    def fused(self, spec: Rrf, k: int) -> DataFrame:
        """(pos, id, score): the plan's nodes ranked by distance and by nearness in the graph, both ranks fused."""
        if spec.off():
            return self.run().filter(F.col("pos") < k)
        return fused(self, spec, k)


class EdgeQuery(Query):
    kind = "edges"

    def filter(self, predicate: Predicate) -> EdgeQuery:
        no_structure(predicate)
        return self._then(EdgeQuery, "filter_edges", predicate=predicate)

    def return_edges(self) -> DataFrame:
        """The edges' rows with pos; those that are gone are left out."""
        return self.run().join(self.graph.edges, "id")


class PathQuery(Query):
    kind = "paths"

    def filter(self, predicate: Predicate):
        raise PlanError("paths can't be filtered")

    def return_paths(self) -> DataFrame:
        return self.run()


class Run:
    def __init__(self, query: Query):
        if query.mode not in MODES:
            raise PlanError(f"unknown mode {query.mode!r}")
        if query.mode == "vector_only":
            raise PlanError("this collection holds vectors only")
        self.graph, self.vectors, self.metric = query.graph, query.vectors, query.metric
        if query.mode == "auto_similarity":
            self.graph = Graph(query.graph.nodes.limit(0), query.graph.edges.limit(0), now_ms=query.graph.now_ms)
        self.spark = query.vectors.sparkSession
        # one clock for the whole query
        self.now_ms = query.now_ms if query.now_ms is not None else int(time.time() * 1000)

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "pos long, id long")

    def run(self, steps: Sequence[Step]) -> tuple[str, DataFrame]:
        kind, frontier = "nodes", None
        for step in steps:
            if step.name in ("vector_similar", "scan") and frontier is not None:
                raise PlanError(f"{step.name} must come first")
            kind, frontier = getattr(self, f"_{step.name}".replace("_except", "_without").replace("_filter_edges", "_filter_of_edges"))(frontier if frontier is not None else self.empty(), **step.args)
        return kind, frontier if frontier is not None else self.empty()

    def sub(self, query: NodeQuery) -> DataFrame:
        if query.kind != "nodes":
            raise PlanError("a plan inside a plan must end on nodes")
        return self.run(query.steps)[1] if query.steps else self.empty()

    def _vector_similar(self, _, query, k, ef):
        return "nodes", search(self.vectors, query, k, self.metric).select((F.col("rank") - 1).cast("long").alias("pos"), "id")

    def _from_nodes(self, _, ids):
        return "nodes", self.spark.createDataFrame([(n, int(i)) for n, i in enumerate(dict.fromkeys(ids))], "pos long, id long")

    def _scan(self, _, entities, label, predicate):
        rows = with_degrees(self.graph.nodes, self.graph.edges, predicate).filter(compiled(predicate)).filter(F.col("id") > 0)
        if entities is not None:
            rows = rows.filter((F.col("kind") == "entity") == F.lit(entities))
        if label is not None:
            rows = rows.filter((F.col("kind") == "entity") & (F.col("label") == label))
        return "nodes", in_order(rows.select("id"), "pos", "id").select("pos", "id")

    def _first(self, rows: DataFrame, key: str, *order) -> DataFrame:
        """Each key once, numbered by the least of order."""
        least = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("o"))
        return _numbered(least, "o", key).select("pos", F.col(key).alias("id"))

    def _traverse(self, frontier, edge_type, direction, temporal):
        near, frontier = incident(self.graph.edges.filter(valid(temporal, self.now_ms)), direction_of(direction), edge_type), cut(frontier)
        joined = frontier.join(from_frontier(near, frontier), F.col("id") == F.col("node"))
        return "nodes", self._first(joined, "neighbour", "pos", "side", "edge_id")

    def _passing(self, ids: DataFrame, predicate: Predicate | None) -> DataFrame:
        """ids whose node passes; an id without a node row passes nothing but a predicate that always holds."""
        from quillon.functions.predicates import Always

        if predicate is None or isinstance(predicate, Always):
            return ids
        rows = with_degrees(self.graph.nodes, self.graph.edges, predicate).filter(compiled(predicate)).select("id")
        return ids.join(rows, "id", "left_semi")

    def _k_hop(self, frontier, most, edge_type, predicate, temporal, weight):
        if weight is not None:
            return self._k_hop_weighted(frontier, most, edge_type, predicate, temporal, weight)
        near = incident(self.graph.edges.filter(valid(temporal, self.now_ms)), "outgoing", edge_type)
        frontier = cut(frontier)
        seen, level, out = frontier.select("id"), frontier, []
        for step in range(most):
            found = level.join(from_frontier(near, level), F.col("id") == F.col("node")).select("pos", "side", "edge_id", F.col("neighbour"))
            found = found.join(seen.withColumnRenamed("id", "neighbour"), "neighbour", "left_anti")
            level = cut(self._passing(self._first(found, "neighbour", "pos", "side", "edge_id"), predicate))
            if level.isEmpty():
                break
            out.append(level.withColumn("step", F.lit(step)))
            seen = seen.union(level.select("id"))
        if not out:
            return "nodes", self.empty()
        every = out[0]
        for part in out[1:]:
            every = every.unionByName(part)
        return "nodes", _numbered(every.withColumnRenamed("pos", "p"), "step", "p").select("pos", "id")

    def _weighted_edges(self, edge_type, temporal, weight) -> DataFrame:
        """(node, neighbour, w), parallel edges each."""
        rows = self.graph.edges.filter(valid(temporal, self.now_ms))
        if edge_type is not None:
            rows = rows.filter(F.col("edge_type") == edge_type)
        return rows.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), effective_weight(weight, self.now_ms).alias("w"))

    def _reach(self, starts: DataFrame, edges: DataFrame, most: int, predicate: Predicate | None) -> DataFrame:
        """(key, id, acc): by start key, the nodes within most hops and the best product of weights of the routes that the walk
        takes; a node goes on with the product by which it was first seen, in order (parent's position, neighbour). Of parallel edges the
        heaviest counts. A position is that of the start and the ids from there on."""
        starts = cut(starts)
        level = starts.select("key", "id", F.array("pos").alias("pos"), F.lit(1.0).alias("w0"))
        seen, best = starts.select("key", "id"), None
        for hop in range(1, most + 1):
            routes = level.join(from_frontier(edges, level), F.col("id") == F.col("node")).select("key", "pos", F.col("neighbour").alias("n"), (F.col("w0") * F.col("w")).alias("p"))
            first = [] if hop == most else [F.min(F.struct("pos", (-F.col("p")).alias("lost"))).alias("first")]
            found = routes.groupBy("key", "n").agg(F.max("p").alias("p"), *first)
            found = found.join(starts.select(F.col("key").alias("k0"), F.col("id").alias("i0")), (F.col("key") == F.col("k0")) & (F.col("n") == F.col("i0")), "left_anti")
            found = cut(self._passing(found.withColumnRenamed("n", "id"), predicate))
            if found.isEmpty():
                break
            best = found.select("key", "id", "p") if best is None else best.unionByName(found.select("key", "id", "p"))
            if hop < most:
                fresh = found.join(seen.select(F.col("key").alias("k1"), F.col("id").alias("i1")), (F.col("key") == F.col("k1")) & (F.col("id") == F.col("i1")), "left_anti")
                level = cut(fresh.select("key", "id", F.concat("first.pos", F.array("id")).alias("pos"), (-F.col("first.lost")).alias("w0")))
                seen = seen.unionByName(level.select("key", "id"))
        if best is None:
            return self.spark.createDataFrame([], "key long, id long, acc double")
        return best.groupBy("key", "id").agg(F.max("p").alias("acc"))

    def _k_hop_weighted(self, frontier, most, edge_type, predicate, temporal, weight):
        starts = frontier.withColumn("key", F.lit(0).cast("long"))
        found = self._reach(starts, self._weighted_edges(edge_type, temporal, weight), most, predicate)
        return "nodes", in_order(found, "pos", F.desc("acc"), "id").select("pos", "id")

    def _shortest_path(self, frontier, target, edge_types, weight):
        schema = "pos long, nodes array<long>"
        if not frontier.filter(F.col("id") == target).isEmpty():
            return "paths", self.spark.createDataFrame([(0, [target])], schema)
        rows = self.graph.edges.filter(F.col("edge_type").isin(list(edge_types))) if edge_types else self.graph.edges
        if weight is not None:
            return "paths", self._cheapest_path(frontier, target, rows, weight)
        near, frontier = incident(rows, "both").select("node", "neighbour", "edge_id"), cut(frontier)
        level = frontier.select("pos", "id", F.array("id").alias("nodes"))
        seen = frontier.select("id")
        while True:
            found = level.join(from_frontier(near, level), F.col("id") == F.col("node")).join(seen.withColumnRenamed("id", "neighbour"), "neighbour", "left_anti")
            order = F.struct("pos", "edge_id")
            first = found.groupBy("neighbour").agg(F.min_by(F.struct(F.concat("nodes", F.array("neighbour")).alias("nodes"), order.alias("o")), order).alias("b"))
            level = cut(_numbered(first.select(F.col("neighbour").alias("id"), "b.nodes", "b.o"), "o").select("pos", "id", "nodes"))
            hit = level.filter(F.col("id") == target)
            if level.isEmpty():
                return "paths", self.spark.createDataFrame([], schema)
            if not hit.isEmpty():
                return "paths", hit.select(F.lit(0).cast("long").alias("pos"), "nodes")
            seen = seen.union(level.select("id"))

    def _cheapest_path(self, frontier, target, rows, weight):
        """Relaxes all improved nodes until none improves; of equal costs the first by path wins."""
        both = incident(rows, "both").join(rows.select(F.col("id").alias("edge_id"), effective_weight(weight, self.now_ms).alias("w")), "edge_id")
        near = cut(both.groupBy("node", "neighbour").agg(cost(F.max("w")).alias("c")))
        best = frontier.select("id", F.lit(0.0).alias("cost"), F.array("id").alias("nodes"))
        changed = best
        while True:
            offers = changed.join(near, F.col("id") == F.col("node")).select(F.col("neighbour").alias("id"), (F.col("cost") + F.col("c")).alias("cost"), F.concat("nodes", F.array("neighbour")).alias("nodes"))
            offers = offers.groupBy("id").agg(F.min(F.struct("cost", "nodes")).alias("o"))
            joined = offers.join(best.withColumnRenamed("cost", "old").drop("nodes"), "id", "left")
            changed = cut(joined.filter(F.col("old").isNull() | (F.col("o.cost") < F.col("old"))).select("id", "o.cost", "o.nodes"))
            if changed.isEmpty():
                break
            best = cut(best.join(changed, "id", "left_anti").unionByName(changed))
        return best.filter(F.col("id") == target).select(F.lit(0).cast("long").alias("pos"), "nodes")

    def _mutual(self, frontier, other):
        one = self._traverse(frontier, None, "both", None)[1]
        two = self._traverse(self.sub(other), None, "both", None)[1]
        return self._intersected(one, two)

    def _intersected(self, one: DataFrame, two: DataFrame):
        return "nodes", _numbered(one.join(two.select("id"), "id", "left_semi").withColumnRenamed("pos", "p"), "p").select("pos", "id")

    def _intersect(self, frontier, other):
        return self._intersected(frontier, self.sub(other))

    def _without(self, frontier, other):
        rows = frontier.join(self.sub(other).select("id"), "id", "left_anti").withColumnRenamed("pos", "p")
        return "nodes", _numbered(rows, "p").select("pos", "id")

    def _union(self, frontier, other):
        both = frontier.withColumn("side", F.lit(0)).unionByName(self.sub(other).withColumn("side", F.lit(1)))
        return "nodes", self._first(both, "id", "side", "pos")

    def _filter(self, frontier, predicate):
        rows = self._passing(frontier, predicate).withColumnRenamed("pos", "p")
        return "nodes", _numbered(rows, "p").select("pos", "id")

    def _filter_of_edges(self, frontier, predicate):
        rows = as_edge_rows(self.graph.edges).filter(compiled(predicate)).select("id")
        return "edges", _numbered(frontier.join(rows, "id", "left_semi").withColumnRenamed("pos", "p"), "p").select("pos", "id")

    def _collect_edges(self, frontier, edge_type, direction):
        near, frontier = incident(self.graph.edges, direction_of(direction), edge_type), cut(frontier)
        return "edges", self._first(frontier.join(from_frontier(near, frontier), F.col("id") == F.col("node")).select("pos", "side", "edge_id"), "edge_id", "pos", "side")

    def _limit(self, frontier, n):
        return "paths" if "nodes" in frontier.columns else "nodes", frontier.filter(F.col("pos") < n)

    def fetched(self, frontier: DataFrame, on_missing: str) -> DataFrame:
        """(pos, id, embedding): a node's own embedding, else its vector; those without either are left out, or an error."""
        if on_missing not in ("skip", "error"):
            raise PlanError(f"on_missing is skip or error, not {on_missing!r}")
        own = self.graph.nodes.filter("embedding is not null").select("id", F.col("embedding").alias("e1"))
        of = self.vectors.select("id", F.col("embedding").alias("e2"))
        rows = frontier.join(own, "id", "left").join(of, "id", "left").select("pos", "id", F.coalesce("e1", "e2").alias("embedding"))
        if on_missing == "error" and not rows.filter("embedding is null").isEmpty():
            raise PlanError("a node without a vector")
        return rows.filter("embedding is not null")

    def ranked(self, rows: DataFrame, score: Column, k: int, descending: bool = False) -> tuple[str, DataFrame]:
        scored = rows.select("id", score.alias("score"))
        key = F.desc("score") if descending else F.asc("score")
        return "nodes", _numbered(scored.orderBy(F.isnan("score"), key, "id").limit(k), F.isnan("score"), key, "id").select("pos", "id", "score")

    def _plain(self, result):
        return result[0], result[1].select("pos", "id")

    def _vector_rank(self, frontier, query, k, on_missing, predicate):
        rows = self.fetched(self._passing(frontier, predicate), on_missing)
        return self._plain(self.ranked(rows, distance(F.col("embedding"), vector(query), self.metric), k))

    def _centroid(self, frontier, k, on_missing):
        rows = self.fetched(frontier, on_missing)
        center = vmath.centroid_table(rows).select("centroid")
        # one row
        return self._plain(self.ranked(rows.crossJoin(F.broadcast(center)), distance(F.col("embedding"), F.col("centroid"), self.metric), k))

    def _diversity(self, frontier, query, k, balance, on_missing):
        found = vmath.diverse(self.fetched(frontier, on_missing), query, k, balance, "pos")
        return "nodes", found.select(F.col("pos").cast("long").alias("pos"), "id")

    def _cone(self, frontier, direction, aperture, k, on_missing):
        found = vmath.cone(self.fetched(frontier, on_missing).select("id", "embedding"), direction, aperture)
        return self._plain(self.ranked(found, F.col("cosine"), k, descending=True))

    def _isolation(self, frontier, centroids, k, on_missing):
        rows = self.fetched(frontier, on_missing)
        return self._plain(self.ranked(rows, vmath.least_distance(centroids, self.metric), k, descending=True))

    def proximity(self, seeds: DataFrame, pool: DataFrame, spec: Rrf) -> DataFrame:
        """(id, near): how often, and how closely, walks from the seeds come to a candidate of the pool."""
        starts = seeds.select(F.col("id").alias("key"), "id", F.lit(0).cast("long").alias("pos"))
        if spec.relations:
            return self._bridged(starts, pool, spec)
        weight = spec.edge_weight or Weight()
        reach = self._reach(starts, self._weighted_edges(None, None, weight), spec.max_hops or 1, None)
        hits = reach.join(seeds.select("id"), "id", "left_anti").join(pool.select("id"), "id", "left_semi")
        factor = F.col("acc") if spec.edge_weight is not None and not spec.edge_weight.nothing() else F.lit(1.0)
        if spec.hub_damping:
            hits = cut(hits)
            hubs = from_frontier(node_edges(self.graph.edges, "both"), hits).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
            hits = hits.join(hubs, "id", "left")
            factor = factor / (1 + spec.hub_damping * F.log1p(F.coalesce("degree", F.lit(0)).cast("double")))
        return hits.groupBy("id").agg(F.sum(factor).alias("near"))

    def _bridged(self, starts: DataFrame, pool: DataFrame, spec: Rrf) -> DataFrame:
        """Passage to entities by mentions, on by each relation, and back to passages; each route counts, damped by the mentions of the entities reached."""
        mention = neighbours(self.graph.edges, "outgoing", spec.mentions).select("node", "neighbour")
        parts = None
        for n, relation in enumerate(spec.relations):
            entities = starts.join(mention, F.col("id") == F.col("node")).select("key", F.col("neighbour").alias("id"), F.lit(0).cast("long").alias("pos")).distinct()
            part = self._reach(entities, self._weighted_edges(relation, None, Weight()), spec.max_hops or 1, None).withColumn("rel", F.lit(n))
            parts = part if parts is None else parts.unionByName(part)
        back = parts.select("key", "rel", F.col("id").alias("entity")).join(mention.withColumnRenamed("neighbour", "entity"), "entity").select("key", "rel", "entity", F.col("node").alias("id"))
        back = back.filter(F.col("id") != F.col("key")).join(pool.select("id"), "id", "left_semi")
        factor = F.lit(1.0)
        if spec.hub_damping:
            into = mention.groupBy(F.col("neighbour").alias("entity")).agg(F.countDistinct("node").alias("degree"))
            back = back.join(into, "entity", "left")
            factor = F.exp(F.sum(-F.log(1 + spec.hub_damping * F.log1p(F.coalesce("degree", F.lit(0)).cast("double")))))
            routes = back.groupBy("key", "rel", "id").agg(factor.alias("f"))
        else:
            routes = back.select("key", "rel", "id").distinct().withColumn("f", F.lit(1.0))
        return routes.groupBy("id").agg(F.sum("f").alias("near"))


def fused(query: NodeQuery, spec: Rrf, k: int) -> DataFrame:
    """Ranks by distance to the first step's vector and by graph proximity to its hits; a rank adds 1 / (rrf_k + rank)."""
    if not query.steps or query.steps[0].name != "vector_similar":
        raise PlanError("fusion needs a plan that starts with vector_similar")
    if query.kind != "nodes":
        raise PlanError("fusion needs a plan that ends on nodes")
    run = Run(query)
    seeds = cut(run.run(query.steps[:1])[1])
    pool = run.run(query.steps)[1]
    if spec.pool:
        pool = pool.filter(F.col("pos") < spec.pool)
    pool = cut(pool)
    target = query.steps[0].args["query"]
    scored = run.fetched(pool, "skip").select("id", distance(F.col("embedding"), vector(target), run.metric).alias("score"))
    near = in_order(scored, "r0", F.isnan("score"), "score", "id").select("id", (F.col("r0") + 1).alias("r1"))
    close = run.proximity(seeds, pool, spec).filter("near > 0").join(pool, "id")
    close = in_order(close.select("id", "near", "pos"), "r0", F.desc("near"), "pos").select("id", (F.col("r0") + 1).alias("r2"))
    base = float(spec.k or RRF_K)
    both = pool.join(near, "id", "left").join(close, "id", "left")
    total = sum((F.coalesce(1 / (F.lit(base) + F.col(r)), F.lit(0.0)) for r in ("r1", "r2")), F.lit(0.0))
    top = both.select("id", F.col("pos").alias("p"), total.alias("score")).orderBy(F.desc("score"), "p").limit(k)
    return _numbered(top, F.desc("score"), "p").select("pos", "id", "score")


def graph_rag(start: NodeQuery, query: Sequence[float], k: int, seeds: int = 10, relations: Sequence[str] = (), hops: int = 1, rrf: Rrf | None = None) -> DataFrame:
    """Nearest vectors, what lies a bridge of relations (or some hops) away, and one ranking of both."""
    base = start.vector_similar(query, seeds)
    plan = base
    if relations:
        for relation in relations:
            plan = plan.union(base.traverse(relation, "both"))
    else:
        plan = plan.union(base.k_hop(hops))
    return plan.fused(rrf, k) if rrf is not None and not rrf.off() else plan.vector_rank(query, k).run()


def from_json(start: NodeQuery, steps: Sequence[dict[str, Any]]):
    """A plan from a list of {"step": name, ...arguments}; plans inside it are lists under "other"."""
    query = start
    for raw in steps:
        args = {k: v for k, v in raw.items() if k != "step"}
        if isinstance(args.get("other"), (list, tuple)):
            args["other"] = from_json(start, args["other"])
        name = raw["step"]
        if name not in ("vector_similar", "from_nodes", "scan", "traverse", "k_hop", "shortest_path", "mutual_neighbours", "intersect", "union", "except_", "filter", "collect_edges", "vector_rank", "analogy", "interpolate", "centroid", "diversity", "cone", "isolation", "limit"):
            raise PlanError(f"unknown step {name!r}")
        if not hasattr(query, name):
            raise PlanError(f"{name} can't follow a frontier of {query.kind}")
        query = getattr(query, name)(**args)
    return query
