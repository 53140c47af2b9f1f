"""The similarity graph: each vector tied to its nearest ones, and queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distance import similarity
from quillon.lineage import cut
from quillon.operators.knn import batch_search

NEAREST, MOST_EDGES, THRESHOLD, MOST_DEPTH = 10, 50, 0.7, 5
GAIN = 0.01


def build(vectors: DataFrame, threshold: float = THRESHOLD, metric: str = "cosine", k: int = NEAREST, most: int = MOST_EDGES, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(src, dst, similarity, refined), both directions: pairs in which one is among the other's k nearest (itself may be one of
    them) and which are at least threshold similar; each node keeps its most similar ones."""
    queries = vectors.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("query"))
    found = batch_search(vectors, queries, k, metric, id_col=id_col, vec_col=vec_col)
    near = found.filter(F.col("qid") != F.col("id")).select(F.col("qid").alias("src"), F.col("id").alias("dst"), similarity(F.col("score"), metric).alias("similarity"))
    near = near.filter(F.col("similarity") >= threshold)
    ends = near.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"), "similarity")
    both = ends.groupBy("e.src", "e.dst").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    kept = both.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")
    return kept.withColumn("refined", F.lit(False))


def resolved_threshold(overrides: DataFrame | None, nodes: DataFrame, query: float | None, default: float) -> DataFrame:
    """(id, threshold): the node's own, else the query's, else the collection's."""
    base = nodes.select("id").distinct()
    if overrides is None:
        return base.withColumn("threshold", F.lit(float(default if query is None else query)))
    own = overrides.select("id", F.col("threshold_override").alias("o"))
    return base.join(own, "id", "left").select("id", F.coalesce("o", F.lit(float(query)) if query is not None else F.lit(None).cast("double"), F.lit(float(default))).alias("threshold"))


def related(sim_edges: DataFrame, ids: DataFrame, threshold: float | None = None, default: float = THRESHOLD, most: int | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(src, dst, similarity, rank) of the given ids' edges at or over each one's threshold, the most similar first."""
    wanted = resolved_threshold(overrides, ids, threshold, default).withColumnRenamed("id", "src")
    rows = sim_edges.join(wanted, "src").filter(F.col("similarity") >= F.col("threshold")).drop("threshold")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")))
    return (rows if most is None else rows.filter(F.col("rank") <= most)).select("src", "dst", "similarity", "rank")


def traverse(sim_edges: DataFrame, start: int, depth: int, threshold: float, most: int | None = None) -> DataFrame:
    """(id, depth, path, path_similarity) of what a breadth-first walk of at most five steps reaches; a node keeps the first path
    that finds it, and paths are ordered by the product of their similarities."""
    spark = sim_edges.sparkSession
    edges = sim_edges.filter(F.col("similarity") >= threshold).select("src", "dst", "similarity")
    level = spark.createDataFrame([(start, 0, 0, [start], 1.0)], "id long, depth int, pos long, path array<long>, path_similarity double")
    seen = level
    for step in range(1, min(depth, MOST_DEPTH) + 1):
        out = level.join(edges, F.col("id") == F.col("src")).join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        order = F.struct(F.col("pos"), (-F.col("similarity")).alias("s"), F.col("dst").alias("d"))
        first = out.groupBy("dst").agg(F.min_by(F.struct(F.concat("path", F.array("dst")).alias("path"), (F.col("path_similarity") * F.col("similarity")).alias("p"), order.alias("o")), order).alias("b"))
        numbered = first.select(F.col("dst").alias("id"), "b.path", F.col("b.p").alias("path_similarity"), F.row_number().over(Window.orderBy("b.o")).cast("long").alias("pos"))
        level = cut(numbered.select("id", F.lit(step).alias("depth"), "pos", "path", "path_similarity"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    found = seen.filter(F.col("depth") > 0).select("id", "depth", "path", "path_similarity").orderBy(F.desc("path_similarity"), "id")
    return found if most is None else found.limit(most)


def relationships(sim_edges: DataFrame, start: int, depth: int, threshold: float, least: float, most: int | None = None) -> DataFrame:
    """traverse, cut to paths whose product is at least least."""
    found = traverse(sim_edges, start, depth, threshold).filter(F.col("path_similarity") >= least).orderBy(F.desc("path_similarity"), "id")
    return found if most is None else found.limit(most)


def depth_first(sim_edges: DataFrame, start: int, depth: int, threshold: float) -> DataFrame:
    """(id, depth, path, path_similarity) of a depth-first walk that marks nodes when it pushes them. What the walk can reach is
    found first and must fit the driver: at most 100,000 edges."""
    reach = traverse(sim_edges, start, depth, threshold).select("id").union(sim_edges.sparkSession.createDataFrame([(start,)], "id long"))
    edges = sim_edges.filter(F.col("similarity") >= threshold).join(reach.withColumnRenamed("id", "src"), "src", "left_semi")
    rows = edges.select("src", "dst", "similarity").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many edges for a depth-first walk")
    near: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (-r["similarity"], r["dst"])):
        near.setdefault(r["src"], []).append((r["dst"], r["similarity"]))
    seen, stack, out = {start}, [(start, 0, [start], 1.0)], []
    while stack:
        node, d, path, product = stack.pop()
        if d:
            out.append((node, d, path, product))
        if d < min(depth, MOST_DEPTH):
            for other, s in near.get(node, []):
                if other not in seen:
                    seen.add(other)
                    stack.append((other, d + 1, [*path, other], product * s))
    return sim_edges.sparkSession.createDataFrame(out, "id long, depth int, path array<long>, path_similarity double").orderBy(F.desc("path_similarity"), "id")


def mutual(sim_edges: DataFrame, a: int, b: int, threshold: float) -> DataFrame:
    """(id) of what both are related to, ascending."""
    rows = sim_edges.filter(F.col("similarity") >= threshold)
    one, two = (rows.filter(F.col("src") == x).select(F.col("dst").alias("id")) for x in (a, b))
    return one.join(two, "id", "left_semi").distinct().orderBy("id")


def find_path(sim_edges: DataFrame, start: int, end: int, depth: int, threshold: float) -> list[int] | None:
    """The nodes of a shortest path, [start] for one node, None if there is none within depth."""
    if start == end:
        return [start]
    row = traverse(sim_edges, start, depth, threshold).filter(F.col("id") == end).first()
    return list(row["path"]) if row is not None else None


def pruned(sim_edges: DataFrame, threshold: float, overrides: DataFrame | None = None) -> DataFrame:
    """The edges at or over threshold; nodes with a threshold of their own keep theirs. Each pair is judged from its smaller id."""
    rows = sim_edges.withColumn("__low", F.least("src", "dst"))
    if overrides is not None:
        own = overrides.filter("threshold_override is not null").select(F.col("id").alias("__low"), F.lit(True).alias("__own"))
        rows = rows.join(own, "__low", "left")
    else:
        rows = rows.withColumn("__own", F.lit(None).cast("boolean"))
    return rows.filter(F.col("__own").isNotNull() | (F.col("similarity") >= threshold)).select(*sim_edges.columns)


def refine(sim_edges: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, metric: str = "cosine", most: int = MOST_EDGES, extra: int = 20) -> DataFrame:
    """A wider search: edges that are new or whose similarity gains at least 0.01 are replaced and marked refined."""
    wide = build(vectors, threshold, metric, most + extra, most).drop("refined").withColumnRenamed("similarity", "s")
    both = sim_edges.join(wide, ["src", "dst"], "full")
    gained = F.col("similarity").isNull() | (F.col("s") - F.col("similarity") >= GAIN)
    better = F.col("s").isNotNull() & gained
    rows = both.select("src", "dst", F.when(better, F.col("s")).otherwise(F.col("similarity")).alias("similarity"), F.when(better, F.lit(True)).otherwise(F.col("refined")).alias("refined"))
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")
