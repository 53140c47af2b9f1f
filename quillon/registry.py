"""The queries of the reference operators over the driver's tables, each with its SQL where SQL can express it.

Vectors are embeddings (id = vec_id + 1). Content nodes are parts (id = key + 1); customers, suppliers, nations and regions are entity
nodes in id ranges of their own. Edges: BOUGHT (customer to part, over orders and line items), SUPPLIED_BY (part to supplier), LOCATED_IN,
PART_OF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import distance as D
from quillon.functions.filters import field, parsed
from quillon.functions.predicates import Among, Compare, Exists, IncidentEdges, Kind, Label, Negated, Property
from quillon.functions.text import content_hash
from quillon.functions.weights import Temporal, Weight, cost, effective_weight, valid
from quillon.operators import extract, graph, knn, quant, simgraph, vmath
from quillon.operators.graph import Graph
from quillon.plans.hybrid import NodeQuery, Rrf

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = 1_000_000_000_000
AXIS = [1.0] * 32 + [-0.5] * 32
OTHER = [0.25] * 16 + [1.0] * 16 + [0.0] * 32
AXIS_SQL = f"{AXIS}::DOUBLE[]"
OTHER_SQL = f"{OTHER}::DOUBLE[]"

VECTORS = "v AS (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
NODES = """
nodes AS (
  SELECT p_partkey + 1 AS id, 'content' AS kind, NULL AS label, p_name AS name, p_size::DOUBLE AS num, p_brand AS tag FROM part
  UNION ALL SELECT c_custkey + 10000000, 'entity', 'Customer', c_name, c_acctbal, c_mktsegment FROM customer
  UNION ALL SELECT s_suppkey + 20000000, 'entity', 'Supplier', s_name, s_acctbal, NULL FROM supplier
  UNION ALL SELECT n_nationkey + 30000000, 'entity', 'Nation', n_name, NULL, NULL FROM nation
  UNION ALL SELECT r_regionkey + 40000000, 'entity', 'Region', r_name, NULL, NULL FROM region)"""
EDGES = """
bought AS (
  SELECT o_custkey * 10000000 + l_partkey AS id, o_custkey + 10000000 AS source, l_partkey + 1 AS target, 'BOUGHT' AS edge_type,
         1 - min(l_discount) AS conf, max(l_quantity) AS qty, min(epoch_ms(o_orderdate)) AS created_at, min(epoch_ms(l_shipdate)) AS valid_from,
         max(epoch_ms(l_shipdate)) + 86400000 AS valid_until, min(l_returnflag) AS context
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey),
supplied AS (
  SELECT 5000000000000000 + l_partkey * 1000000 + l_suppkey, l_partkey + 1, l_suppkey + 20000000, 'SUPPLIED_BY', 1, max(l_quantity), min(epoch_ms(l_shipdate)), NULL, NULL, NULL
  FROM lineitem GROUP BY l_partkey, l_suppkey),
edges AS (
  SELECT * FROM bought UNION ALL SELECT * FROM supplied
  UNION ALL SELECT 6000000000000000 + c_custkey, c_custkey + 10000000, c_nationkey + 30000000, 'LOCATED_IN', 1, NULL, 0, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 7000000000000000 + s_suppkey, s_suppkey + 20000000, s_nationkey + 30000000, 'LOCATED_IN', 1, NULL, 0, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 8000000000000000 + n_nationkey, n_nationkey + 30000000, n_regionkey + 40000000, 'PART_OF', 1, NULL, 0, NULL, NULL, NULL FROM nation)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"), "embedding", "label")


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors with the metadata of the part of the same key."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("id"), "p_brand", "p_type", "p_size", "p_retailprice")
    return vectors(spark, sf_dir).join(part, "id", "left")


#: Bytes of a table's files whose rows a task joins or groups.
TASK_BYTES = 4 << 20


def tasks_for(df: DataFrame) -> int:
    """How many tasks take a table that is read from files, so that what one holds doesn't grow with the table."""
    n = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    return n if n <= 1 else max(n, df.sparkSession.sparkContext.defaultParallelism)


def property_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    content = lambda df, key, name, num, tag: df.select((F.col(key) + 1).alias("id"), F.lit("content").alias("kind"), F.to_json(F.struct(F.col(name).alias("name"), F.col(num).cast("double").alias("num"), F.col(tag).alias("tag"))).alias("properties"))
    entity = lambda df, key, base, label, *props: df.select((F.col(key) + base).cast("long").alias("id"), F.lit("entity").alias("kind"), F.lit(label).alias("label"), F.to_json(F.struct(*props)).alias("properties"))
    parts = [
        content(t("part"), "p_partkey", "p_name", "p_size", "p_brand"),
        entity(t("customer"), "c_custkey", 10_000_000, "Customer", F.col("c_name").alias("name"), F.col("c_acctbal").alias("num"), F.col("c_mktsegment").alias("tag")),
        entity(t("supplier"), "s_suppkey", 20_000_000, "Supplier", F.col("s_name").alias("name"), F.col("s_acctbal").alias("num")),
        entity(t("nation"), "n_nationkey", 30_000_000, "Nation", F.col("n_name").alias("name")),
        entity(t("region"), "r_regionkey", 40_000_000, "Region", F.col("r_name").alias("name")),
    ]
    nodes = graph.shaped(parts[0], graph.NODES)
    for p in parts[1:]:
        nodes = nodes.unionByName(graph.shaped(p, graph.NODES))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    n = tasks_for(t("lineitem"))
    sold = t("orders").repartition(n, "o_orderkey").join(t("lineitem").repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    bought = sold.repartition(n, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(
        (1 - F.min("l_discount")).alias("confidence"), F.max("l_quantity").alias("qty"), F.min(ms("o_orderdate")).alias("created_at"), F.min(ms("l_shipdate")).alias("valid_from"), (F.max(ms("l_shipdate")) + 86_400_000).alias("valid_until"), F.min("l_returnflag").alias("temporal_context")
    )
    qty = F.to_json(F.struct("qty")).alias("properties")
    bought = bought.select((F.col("o_custkey") * 10_000_000 + F.col("l_partkey")).alias("id"), (F.col("o_custkey") + 10_000_000).alias("source"), (F.col("l_partkey") + 1).alias("target"), F.lit("BOUGHT").alias("edge_type"), qty, "confidence", "created_at", "valid_from", "valid_until", "temporal_context")
    supplied = t("lineitem").repartition(n, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("qty"), F.min(ms("l_shipdate")).alias("created_at"))
    supplied = supplied.select((F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") + 5_000_000_000_000_000).alias("id"), (F.col("l_partkey") + 1).alias("source"), (F.col("l_suppkey") + 20_000_000).alias("target"), F.lit("SUPPLIED_BY").alias("edge_type"), qty, F.lit(1.0).alias("confidence"), "created_at")
    place = lambda df, key, base, own, to, other, kind: df.select((F.col(key) + base).cast("long").alias("id"), (F.col(key) + own).cast("long").alias("source"), (F.col(to) + other).cast("long").alias("target"), F.lit(kind).alias("edge_type"), F.lit("{}").alias("properties"), F.lit(1.0).alias("confidence"), F.lit(0).alias("created_at"))
    edges = graph.shaped(bought, graph.EDGES)
    for p in (
        supplied,
        place(t("customer"), "c_custkey", 6_000_000_000_000_000, 10_000_000, "c_nationkey", 30_000_000, "LOCATED_IN"),
        place(t("supplier"), "s_suppkey", 7_000_000_000_000_000, 20_000_000, "s_nationkey", 30_000_000, "LOCATED_IN"),
        place(t("nation"), "n_nationkey", 8_000_000_000_000_000, 30_000_000, "n_regionkey", 40_000_000, "PART_OF"),
    ):
        edges = edges.unionByName(graph.shaped(p, graph.EDGES))
    return Graph(nodes, edges, now_ms=NOW)


def start(spark: SparkSession, sf_dir: str) -> NodeQuery:
    return NodeQuery(property_graph(spark, sf_dir), vectors(spark, sf_dir), now_ms=NOW)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- distances and search ---

DIST = {
    "cosine": "list_cosine_distance(e, {q})",
    "euclidean": "list_distance(e, {q})",
    "dot_product": "-list_inner_product(e, {q})",
    "manhattan": "list_sum(list_transform(list_zip(e, {q}), lambda x: abs(x[1] - x[2])))",
}


@query(f"WITH {VECTORS} SELECT id, " + ", ".join(f"round({DIST[m].format(q=AXIS_SQL)}, 6) AS {m}" for m in D.METRICS) + f", round(list_distance(e, {AXIS_SQL}) ** 2, 6) AS squared, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM v")
def distances(spark, sf_dir):
    q = D.vector(AXIS)
    e = F.col("embedding")
    columns = [F.round(D.distance(e, q, m), 6).alias(m) for m in D.METRICS]
    return vectors(spark, sf_dir).select("id", *columns, F.round(D.squared_euclidean_distance(e, q), 6).alias("squared"), F.round(D.norm(e), 6).alias("norm"))


@query(f"WITH {VECTORS}, d AS (SELECT id, list_cosine_distance(e, {AXIS_SQL}) AS c, list_distance(e, {AXIS_SQL}) AS l, list_inner_product(e, {AXIS_SQL}) AS p FROM v) SELECT id, round(1 - c, 6) AS cosine, round(1 / (1 + l), 6) AS euclidean, round(p, 6) AS dot_product FROM d")
def similarities(spark, sf_dir):
    e, q = F.col("embedding"), D.vector(AXIS)
    return vectors(spark, sf_dir).select("id", *[F.round(D.similarity(D.distance(e, q, m), m), 6).alias(m) for m in ("cosine", "euclidean", "dot_product")])


@query(f"WITH {VECTORS}, n AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS n FROM v) SELECT id, dim - 1 AS dim, round(e[dim] / n, 6) AS x FROM n, (SELECT unnest(range(1, 65)) AS dim)")
def normalized_vectors(spark, sf_dir):
    return vmath.unit(vectors(spark, sf_dir)).select("id", F.posexplode("embedding").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


for _m in D.METRICS:

    def _knn(spark, sf_dir, m=_m):
        return rounded(knn.search(vectors(spark, sf_dir), AXIS, 10, m), "score").select("id", "score", F.col("rank").cast("long").alias("rank"))

    QUERIES[f"knn_{_m}"] = _knn
    SQL[f"knn_{_m}"] = f"WITH {VECTORS}, d AS (SELECT id, {DIST[_m].format(q=AXIS_SQL)} AS d FROM v) SELECT id, round(d, 6) AS score, row_number() OVER (ORDER BY d, id) AS rank FROM d QUALIFY rank <= 10"


@query(f"WITH {VECTORS}, d AS (SELECT a.id AS qid, b.id, list_cosine_distance(a.e, b.e) AS d FROM v a CROSS JOIN v b WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM d) SELECT qid, id, round(d, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_batch(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 50, against all."""
    v = vectors(spark, sf_dir)
    queries = v.filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
    found = knn.batch_search(v, queries, 10)
    return found.select("qid", "id", (F.round("score", 6) + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


PRICED = "m AS (SELECT v.*, p_brand, p_type, p_size, p_retailprice FROM v LEFT JOIN part ON v.id = p_partkey + 1)"


def _filters():
    return {
        "eq": (field("p_brand").eq("Brand#11"), "coalesce(p_brand = 'Brand#11', false)"),
        "ne": (field("p_brand").ne("Brand#11"), "coalesce(p_brand <> 'Brand#11', false)"),
        "range": (field("p_size").gt(10) & field("p_size").lte(40.0), "coalesce(p_size > 10 AND p_size <= 40, false)"),
        "string_order": (field("p_type").gte("M") & field("p_type").lt("T"), "coalesce(p_type >= 'M' AND p_type < 'T', false)"),
        "in": (field("label").in_([1, 3, 5.0]), "label IN (1, 3, 5)"),
        "exists": (field("p_brand").exists(), "p_brand IS NOT NULL"),
        "contains": (field("p_type").contains("E"), "coalesce(contains(p_type, 'E'), false)"),
        "logic": (parsed({"or": [{"not": {"field": "p_size", "op": "lt", "value": 30}}, {"and": [{"field": "label", "op": "eq", "value": 2}, {"field": "absent", "op": "ne", "value": 1}]}]}), "NOT coalesce(p_size < 30, false)"),
        "mismatch": (~field("p_size").eq("10"), "true"),
    }


for _name, (_filter, _where) in _filters().items():

    def _filtered(spark, sf_dir, f=_filter):
        rows = priced(spark, sf_dir)
        from quillon.functions.filters import compiled

        return rows.filter(compiled(f, rows.schema)).select("id", "label")

    QUERIES[f"filter_{_name}"] = _filtered
    SQL[f"filter_{_name}"] = f"WITH {VECTORS}, {PRICED} SELECT id, label FROM m WHERE {_where}"


@query(f"WITH {VECTORS}, {PRICED}, d AS (SELECT id, list_cosine_distance(e, {AXIS_SQL}) AS d FROM m WHERE p_size > 20) SELECT id, round(d, 6) AS score, row_number() OVER (ORDER BY d, id) AS rank FROM d QUALIFY rank <= 10")
def search_pre_filter(spark, sf_dir):
    return rounded(knn.filtered_search(priced(spark, sf_dir), AXIS, 10, field("p_size").gt(20), "pre_filter"), "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VECTORS}, {PRICED}, d AS (SELECT id, p_size, list_cosine_distance(e, {AXIS_SQL}) AS d FROM m), t AS (SELECT * FROM d ORDER BY d, id LIMIT 30), f AS (SELECT * FROM t WHERE p_size > 20) SELECT id, round(d, 6) AS score, row_number() OVER (ORDER BY d, id) AS rank FROM f QUALIFY rank <= 10")
def search_post_filter(spark, sf_dir):
    return rounded(knn.filtered_search(priced(spark, sf_dir), AXIS, 10, field("p_size").gt(20), "post_filter"), "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VECTORS}, {PRICED}, d AS (SELECT id, p_brand, label, list_cosine_distance(e, {AXIS_SQL}) AS d FROM m WHERE label IN (1, 2)) SELECT id, label, p_brand, round(d, 6) AS score FROM d ORDER BY d, id LIMIT 10")
def search_auto_with_metadata(spark, sf_dir):
    rows = priced(spark, sf_dir)
    return rounded(knn.with_metadata(knn.filtered_search(rows, AXIS, 10, field("label").in_([1, 2])), rows), "score").select("id", "label", "p_brand", "score")


@query(f"WITH {VECTORS}, d AS (SELECT 0 AS qid, id, list_cosine_distance(e, {AXIS_SQL}) AS d, 5 AS k FROM v UNION ALL SELECT 1, id, list_distance(e, {OTHER_SQL}), 7 FROM v WHERE label = 3), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM d) SELECT qid, id, round(d, 6) AS score, rank FROM r WHERE rank <= k")
def search_mixed_batch(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = knn.mixed_batch([knn.Request(v, AXIS, 5), knn.Request(v, OTHER, 7, "euclidean", field("label").eq(3))])
    return rounded(found, "score").withColumn("rank", F.col("rank").cast("long"))


# --- graph ---

_P = lambda name, op, value: Compare(Property(name), op, value)
PREDICATES = {
    "number": (_P("num", "ge", 25), "num >= 25"),
    "text": (_P("tag", "eq", "BUILDING") | _P("name", "lt", "Customer#000000100"), "tag = 'BUILDING' OR name < 'Customer#000000100'"),
    "missing_ne": (_P("tag", "ne", "BUILDING"), "tag IS NOT NULL AND tag <> 'BUILDING'"),
    "among": (Among(Property("tag"), ("BUILDING", "MACHINERY")), "tag IN ('BUILDING', 'MACHINERY')"),
    "not_among": (Among(Property("tag"), ("BUILDING", "MACHINERY"), negated=True), "tag IS NOT NULL AND tag NOT IN ('BUILDING', 'MACHINERY')"),
    "exists": (Exists(Property("num")), "num IS NOT NULL"),
    "label_kind": (Compare(Label(), "eq", "Nation") | Negated(Compare(Kind(), "eq", "entity")), "label = 'Nation' OR kind <> 'entity'"),
    "degree": (Compare(IncidentEdges("BOUGHT", "incoming"), "ge", 12), "id IN (SELECT target FROM edges WHERE edge_type = 'BOUGHT' GROUP BY 1 HAVING count(*) >= 12)"),
    "degree_both": (Compare(IncidentEdges(None, "both"), "gt", 40), "id IN (SELECT n FROM (SELECT source AS n, id FROM edges UNION SELECT target, id FROM edges) GROUP BY n HAVING count(*) > 40)"),
}
for _name, (_predicate, _where) in PREDICATES.items():

    def _predicated(spark, sf_dir, p=_predicate):
        return start(spark, sf_dir).scan(predicate=p).run().select("id")

    QUERIES[f"predicate_{_name}"] = _predicated
    SQL[f"predicate_{_name}"] = f"WITH {NODES}, {EDGES} SELECT id FROM nodes WHERE {_where}"


@query(f"WITH {EDGES} SELECT source AS node, target AS neighbour FROM edges WHERE edge_type = 'LOCATED_IN' UNION SELECT target, source FROM edges WHERE edge_type = 'LOCATED_IN'")
def graph_neighbours(spark, sf_dir):
    return graph.neighbours(property_graph(spark, sf_dir).edges, "both", "LOCATED_IN").select("node", "neighbour")


@query(f"WITH {EDGES} SELECT n AS node, count(*) AS degree FROM (SELECT source AS n, id FROM edges UNION SELECT target, id FROM edges) GROUP BY n")
def graph_degrees(spark, sf_dir):
    return graph.degrees(property_graph(spark, sf_dir).edges, "both")


@query(f"WITH {EDGES} SELECT n AS node, count(*) AS n_edges, sum(id % 1000003)::BIGINT AS check_sum FROM (SELECT source AS n, id FROM edges WHERE edge_type = 'BOUGHT' UNION SELECT target, id FROM edges WHERE edge_type = 'BOUGHT') GROUP BY n")
def graph_node_edges(spark, sf_dir):
    found = graph.node_edges(property_graph(spark, sf_dir).edges, "both", "BOUGHT")
    return found.groupBy("node").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("edge_id") % 1000003).alias("check_sum"))


W = Weight("qty", True, 0.93, 3.0e10)
W_SQL = f"greatest(coalesce(qty, 1) * least(greatest(conf::FLOAT::DOUBLE, 0.93::DOUBLE), 1) * pow(2::DOUBLE, -greatest({NOW} - created_at, 0)::DOUBLE / 3e10), 1e-6)"


@query(f"WITH {EDGES} SELECT source AS node, target AS neighbour, round(max({W_SQL}), 6) AS weight FROM edges GROUP BY 1, 2")
def graph_weighted_neighbours(spark, sf_dir):
    return rounded(graph.weighted_neighbours(property_graph(spark, sf_dir).edges, W, NOW), "weight")


@query(f"WITH {EDGES}, w AS (SELECT id, {W_SQL} AS w FROM edges) SELECT id, round(w, 6) AS weight, round(least(greatest(1 / w, 1e-6), 1e12), 4) AS cost FROM w")
def edge_weights(spark, sf_dir):
    w = property_graph(spark, sf_dir).edges.select("id", effective_weight(W, NOW).alias("w"))
    return w.select("id", F.round("w", 6).alias("weight"), F.round(cost(F.col("w")), 4).alias("cost"))


AS_OF = 915_148_800_000


@query(f"WITH {EDGES} SELECT id FROM edges WHERE valid_from IS NULL AND valid_until IS NULL OR valid_from <= {AS_OF} AND {AS_OF} < valid_until")
def edges_valid_at(spark, sf_dir):
    return property_graph(spark, sf_dir).edges.filter(valid(Temporal(AS_OF), NOW)).select("id")


@query(f"WITH {EDGES} SELECT DISTINCT source AS node, target AS neighbour FROM edges WHERE context = 'R' AND valid_from <= {AS_OF} AND {AS_OF} < valid_until")
def temporal_neighbours(spark, sf_dir):
    return graph.neighbours(property_graph(spark, sf_dir).edges, temporal=Temporal(AS_OF, False, "R"), now_ms=NOW).select("node", "neighbour")


@query(f"WITH {NODES}, p AS (SELECT id FROM nodes WHERE id > 10000100 AND kind = 'entity' AND label = 'Customer' AND num > 0 ORDER BY id LIMIT 101) SELECT id, CASE WHEN (SELECT count(*) FROM p) > 100 THEN (SELECT max(id) FROM (SELECT id FROM p ORDER BY id LIMIT 100)) ELSE 0 END AS next_cursor FROM p ORDER BY id LIMIT 100")
def enumerate_nodes(spark, sf_dir):
    """A page is the feature."""
    g = property_graph(spark, sf_dir)
    return graph.enumerate_nodes(g.nodes, g.edges, 10_000_100, 100, "entity", "Customer", _P("num", "gt", 0)).select("id", "next_cursor")


@query(f"WITH {NODES}, {EDGES} SELECT e.id, CASE WHEN count(*) OVER () > 10000 THEN -1 ELSE 0 END AS next_cursor FROM edges e WHERE edge_type = 'LOCATED_IN' AND (source IN (SELECT id FROM nodes WHERE label = 'Supplier') OR target IN (SELECT id FROM nodes WHERE label = 'Supplier'))")
def enumerate_edges(spark, sf_dir):
    """Every edge; next_cursor is -1 if a page can't hold them."""
    g = property_graph(spark, sf_dir)
    return graph.enumerate_edges(g.edges, g.nodes, 0, -1, "LOCATED_IN", end_kind="entity", end_label="Supplier").select("id", "next_cursor")


@query(f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) - 1 AS n_nodes, (SELECT count(*) FROM edges WHERE source <> 30000003 AND target <> 30000003) AS n_edges")
def delete_node_cascade(spark, sf_dir):
    g = property_graph(spark, sf_dir).delete_node(30_000_003)
    return g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("n_edges")))


@query("SELECT 8000000000000002 AS id, true AS verified, 'verified' AS action, 1 AS n_history")
def verify_edge(spark, sf_dir):
    e = property_graph(spark, sf_dir).verify_edge(8_000_000_000_000_002, "me").get_edge(8_000_000_000_000_002)
    return e.select("id", "verified", F.element_at("history", -1)["action"].alias("action"), F.size("history").cast("long").alias("n_history"))


# --- hybrid plans ---

SEED = f"s AS (SELECT id, row_number() OVER (ORDER BY list_cosine_distance(e, {AXIS_SQL}), id) - 1 AS pos FROM v QUALIFY pos < 20)"


@query(f"WITH {VECTORS}, {SEED} SELECT id, pos FROM s")
def hybrid_vector_similar(spark, sf_dir):
    return start(spark, sf_dir).vector_similar(AXIS, 20).run()


@query("SELECT * FROM (VALUES (5, 0), (3, 1), (9, 2)) t(id, pos)")
def hybrid_from_nodes(spark, sf_dir):
    return start(spark, sf_dir).from_nodes([5, 3, 5, 9]).run()


@query(f"WITH {NODES} SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM nodes WHERE label = 'Supplier' AND num > 1000")
def hybrid_scan(spark, sf_dir):
    return start(spark, sf_dir).scan(True, "Supplier", _P("num", "gt", 1000)).run()


HOP = f"""{VECTORS}, {SEED}, {EDGES},
h AS (SELECT target AS id, min((s.pos, e.id)) AS o FROM s JOIN edges e ON e.source = s.id WHERE edge_type = 'SUPPLIED_BY' GROUP BY target)"""


@query(f"WITH {HOP} SELECT id, row_number() OVER (ORDER BY o) - 1 AS pos FROM h")
def hybrid_traverse(spark, sf_dir):
    return start(spark, sf_dir).vector_similar(AXIS, 20).traverse("SUPPLIED_BY").run()


@query(f"WITH {HOP}, t AS (SELECT id FROM h UNION SELECT target FROM h JOIN edges e ON e.source = h.id UNION SELECT e2.target FROM h JOIN edges e ON e.source = h.id JOIN edges e2 ON e2.source = e.target) SELECT id FROM t WHERE id NOT IN (SELECT id FROM s)")
def hybrid_k_hop(spark, sf_dir):
    """Supplier, nation and region of the nearest parts."""
    return start(spark, sf_dir).vector_similar(AXIS, 20).k_hop(3).run().select("id")


@query(f"WITH {VECTORS}, {SEED}, {EDGES}, {NODES}, a AS (SELECT DISTINCT target AS id FROM s JOIN edges e ON e.source = s.id JOIN nodes n ON n.id = e.target WHERE n.num > 3000), b AS (SELECT DISTINCT target AS id FROM a JOIN edges e ON e.source = a.id JOIN nodes n ON n.id = e.target WHERE n.num > 3000) SELECT id FROM a UNION SELECT id FROM b")
def hybrid_k_hop_predicate(spark, sf_dir):
    return start(spark, sf_dir).vector_similar(AXIS, 20).k_hop(2, predicate=_P("num", "gt", 3000)).run().select("id")


def region_of(spark, sf_dir) -> int:
    """The region that customer 1 lives in."""
    g = property_graph(spark, sf_dir)
    nation = g.edges.filter("source = 10000001 and edge_type = 'LOCATED_IN'").select(F.col("target").alias("n"))
    return nation.join(g.edges.filter("edge_type = 'PART_OF'"), F.col("n") == F.col("source")).first()["target"]


@query("SELECT 0 AS pos, 3 AS n_nodes, 10000001 AS first, 40000000 + n_regionkey AS last FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def hybrid_shortest_path(spark, sf_dir):
    region = region_of(spark, sf_dir)
    path = start(spark, sf_dir).from_nodes([10_000_001]).shortest_path(region, ["LOCATED_IN", "PART_OF"]).return_paths()
    return path.select("pos", F.size("nodes").cast("long").alias("n_nodes"), F.element_at("nodes", 1).alias("first"), F.element_at("nodes", -1).alias("last"))


@query(f"WITH {NODES}, {VECTORS}, {SEED} SELECT id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM s WHERE id IN (SELECT id FROM nodes WHERE num > 25)")
def hybrid_intersect(spark, sf_dir):
    s = start(spark, sf_dir)
    return s.vector_similar(AXIS, 20).intersect(s.scan(False, predicate=_P("num", "gt", 25))).run()


@query(f"WITH {VECTORS}, {SEED}, u AS (SELECT id, 0 AS side, pos FROM s UNION ALL SELECT * FROM (VALUES (1, 1, 0), (2, 1, 1), (77, 1, 2))), g AS (SELECT id, min((side, pos)) AS o FROM u GROUP BY id) SELECT id, row_number() OVER (ORDER BY o) - 1 AS pos FROM g")
def hybrid_union(spark, sf_dir):
    s = start(spark, sf_dir)
    return s.vector_similar(AXIS, 20).union(s.from_nodes([1, 2, 77])).run()


@query(f"WITH {NODES}, {VECTORS}, {SEED} SELECT id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM s WHERE id NOT IN (SELECT id FROM nodes WHERE num > 25)")
def hybrid_except(spark, sf_dir):
    s = start(spark, sf_dir)
    return s.vector_similar(AXIS, 20).except_(s.scan(False, predicate=_P("num", "gt", 25))).run()


@query(f"WITH {NODES}, {VECTORS}, {SEED}, f AS (SELECT s.id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM s JOIN nodes n ON n.id = s.id WHERE tag <> 'Brand#11') SELECT f.id, f.pos, kind, label FROM f LEFT JOIN nodes n ON n.id = f.id WHERE pos < 5")
def hybrid_filter_limit_nodes(spark, sf_dir):
    return start(spark, sf_dir).vector_similar(AXIS, 20).filter(_P("tag", "ne", "Brand#11")).limit(5).return_nodes().drop("properties")


@query(f"WITH {VECTORS}, {SEED}, {EDGES} SELECT e.id, e.edge_type FROM edges e WHERE target IN (SELECT id FROM s) AND edge_type = 'BOUGHT' AND qty > 40")
def hybrid_collect_edges(spark, sf_dir):
    return start(spark, sf_dir).vector_similar(AXIS, 20).collect_edges("BOUGHT", "incoming").filter(_P("qty", "gt", 40) & Compare(Label(), "eq", "BOUGHT")).return_edges().select("id", "edge_type")


@query(f"WITH {NODES}, {VECTORS}, d AS (SELECT v.id, list_cosine_distance(e, {OTHER_SQL}) AS d FROM v JOIN nodes n ON n.id = v.id WHERE n.num <= 25) SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS pos FROM d QUALIFY pos < 10")
def hybrid_vector_rank(spark, sf_dir):
    return start(spark, sf_dir).scan(False).vector_rank(OTHER, 10, predicate=_P("num", "le", 25)).run()


ABC = (AXIS, OTHER, [0.1] * 64)


@query(f"WITH {NODES}, {VECTORS}, d AS (SELECT v.id, list_cosine_distance(e, {vmath.analogy(*ABC)}::DOUBLE[]) AS d FROM v WHERE id IN (SELECT id FROM nodes)) SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS pos FROM d QUALIFY pos < 10")
def hybrid_analogy(spark, sf_dir):
    return start(spark, sf_dir).scan(False).analogy(*ABC, 10).run()


UNIT_A, UNIT_B = [0.125] * 64, [0.125] * 32 + [-0.125] * 32


@query(f"WITH {NODES}, {VECTORS}, d AS (SELECT v.id, list_cosine_distance(e, {vmath.slerp(UNIT_A, UNIT_B, 0.3)}::DOUBLE[]) AS d FROM v WHERE id IN (SELECT id FROM nodes)) SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS pos FROM d QUALIFY pos < 10")
def hybrid_interpolate(spark, sf_dir):
    return start(spark, sf_dir).scan(False).interpolate(UNIT_A, UNIT_B, 0.3, 10).run()


@query()
def hybrid_diversity(spark, sf_dir):
    return start(spark, sf_dir).scan(False).diversity(AXIS, 10, 0.5).run()


@query(f"WITH {NODES}, {VECTORS}, d AS (SELECT id, 1 - list_cosine_distance(e, {AXIS_SQL}) AS c FROM v WHERE id IN (SELECT id FROM nodes)) SELECT id, row_number() OVER (ORDER BY c DESC, id) - 1 AS pos FROM d WHERE c >= cos(1.5::DOUBLE) QUALIFY pos < 10")
def hybrid_cone(spark, sf_dir):
    return start(spark, sf_dir).scan(False).cone(AXIS, 1.5, 10).run()


@query(f"WITH {NODES}, {VECTORS}, d AS (SELECT id, least(list_cosine_distance(e, {AXIS_SQL}), list_cosine_distance(e, {OTHER_SQL})) AS d FROM v WHERE id IN (SELECT id FROM nodes)) SELECT id, row_number() OVER (ORDER BY d DESC, id) - 1 AS pos FROM d QUALIFY pos < 10")
def hybrid_isolation(spark, sf_dir):
    return start(spark, sf_dir).scan(False).isolation([AXIS, OTHER], 10).run()


CENTER = "c AS (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, avg(e[dim]) AS m FROM {from_} CROSS JOIN (SELECT unnest(range(1, 65)) AS dim) GROUP BY dim))"


@query(f"WITH {NODES}, {VECTORS}, f AS (SELECT * FROM v WHERE id IN (SELECT id FROM nodes)), {CENTER.format(from_='f')}, d AS (SELECT id, list_cosine_distance(e, c) AS d FROM f CROSS JOIN c) SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS pos FROM d QUALIFY pos < 10")
def hybrid_centroid(spark, sf_dir):
    return start(spark, sf_dir).scan(False).centroid(10).run()


@query()
def hybrid_rrf_damped(spark, sf_dir):
    s = start(spark, sf_dir)
    seeds = s.vector_similar(AXIS, 20)
    return rounded(seeds.union(seeds.k_hop(2)).fused(Rrf(max_hops=2, hub_damping=0.5, edge_weight=Weight("qty")), 15), "score")


# --- similarity graph ---

SIM = f"""{VECTORS}, d AS (SELECT a.id AS a, b.id AS b, list_cosine_distance(a.e, b.e) AS d FROM v a CROSS JOIN v b),
near AS (SELECT a, b, 1 - d AS s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rn FROM d) WHERE rn <= 10 AND a <> b AND 1 - d >= 0.3),
sim AS (SELECT src, dst, max(s) AS similarity FROM (SELECT a AS src, b AS dst, s FROM near UNION ALL SELECT b, a, s FROM near) GROUP BY src, dst)"""


@query(f"WITH {SIM} SELECT src, dst, round(similarity, 6) AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 50")
def similarity_graph(spark, sf_dir):
    return rounded(simgraph.build(vectors(spark, sf_dir), 0.3), "similarity").drop("refined")


@query(f"WITH {SIM} SELECT src, dst, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY src ORDER BY round(similarity, 9) DESC, dst) AS rank FROM sim WHERE similarity >= 0.4 QUALIFY rank <= 5")
def similarity_related(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(simgraph.related(simgraph.build(v, 0.3), v.select("id"), 0.4, most=5), "similarity").withColumn("rank", F.col("rank").cast("long"))


# --- vector mathematics ---


@query(f"WITH {VECTORS} SELECT dim - 1 AS dim, round(avg(e[dim]), 6) AS x FROM v CROSS JOIN (SELECT unnest(range(1, 65)) AS dim) GROUP BY dim")
def math_centroid(spark, sf_dir):
    return vmath.centroid_table(vectors(spark, sf_dir)).select(F.posexplode("centroid").alias("dim", "x")).select(F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"WITH {VECTORS} SELECT dim - 1 AS dim, round(sum(e[dim] * (label + 1)) / sum(label + 1), 6) AS x FROM v CROSS JOIN (SELECT unnest(range(1, 65)) AS dim) GROUP BY dim")
def math_weighted_centroid(spark, sf_dir):
    return vmath.centroid_table(vectors(spark, sf_dir), F.col("label") + 1).select(F.posexplode("centroid").alias("dim", "x")).select(F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"WITH {VECTORS}, d AS (SELECT id, least(list_distance(e, {UNIT_A}::DOUBLE[]), list_distance(e, {UNIT_B}::DOUBLE[])) AS d FROM v) SELECT id, round(d, 6) AS isolation FROM d WHERE d > 1.4")
def math_ghosts(spark, sf_dir):
    return rounded(vmath.ghosts(vectors(spark, sf_dir), 1.4, [UNIT_A, UNIT_B]), "isolation")


@query(f"WITH {VECTORS}, d AS (SELECT id, 1 - list_cosine_distance(e, {AXIS_SQL}) AS c FROM v) SELECT id, round(c, 6) AS cosine, round(acos(c), 6) AS angle FROM d WHERE c >= cos(1.5::DOUBLE)")
def math_cone(spark, sf_dir):
    return rounded(vmath.cone(vectors(spark, sf_dir), AXIS, 1.5), "cosine", "angle")


@query(f"WITH {VECTORS}, a AS (SELECT * FROM v WHERE label < 5), b AS (SELECT * FROM v WHERE label >= 5), {CENTER.format(from_='a').replace('c AS', 'c1 AS', 1)}, {CENTER.format(from_='b').replace('c AS', 'c2 AS', 1)}, m AS (SELECT (SELECT list_distance(c1.c, c2.c) FROM c1, c2) AS s, (SELECT avg(list_distance(e, c)) FROM a, c1) AS m1, (SELECT avg(list_distance(e, c)) FROM b, c2) AS m2) SELECT round(s, 6) AS centroid_shift, round(m1, 6) AS mean_distance_1, round(m2, 6) AS mean_distance_2, round(m2 / m1, 6) AS spread_change, s > 0.01 AS has_drifted FROM m")
def math_drift(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(vmath.drift(v.filter("label < 5"), v.filter("label >= 5"), threshold=0.01), "centroid_shift", "mean_distance_1", "mean_distance_2", "spread_change")


@query(f"WITH {VECTORS} SELECT a.id, dim - 1 AS dim, round(a.e[dim] + 0.25 * (b.e[dim] - a.e[dim]), 6) AS x FROM v a JOIN v b ON b.id = a.id + 1 CROSS JOIN (SELECT unnest(range(1, 65)) AS dim)")
def math_interpolation(spark, sf_dir):
    v = vectors(spark, sf_dir)
    pairs = v.select("id", F.col("embedding").alias("a")).join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b")), "id")
    return vmath.interpolated(pairs, 0.25).select("id", F.posexplode("point").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query()
def math_kmeans(spark, sf_dir):
    return rounded(vmath.kmeans(vectors(spark, sf_dir), 8, seed=1).assignments, "distance")


@query()
def math_pca(spark, sf_dir):
    return vmath.pca(vectors(spark, sf_dir), 2).transform(vectors(spark, sf_dir)).select("id", F.round(F.abs(F.col("projected")[0]), 4).alias("first"))


@query()
def math_diversity(spark, sf_dir):
    return rounded(vmath.diverse(vectors(spark, sf_dir), AXIS, 10, 0.7), "score")


@query()
def math_max_diversity(spark, sf_dir):
    return vmath.spread_out(vectors(spark, sf_dir), 10)


# --- quantisation ---

RANGES = f"""{VECTORS}, p AS (SELECT id, dim, e[dim] AS x FROM v CROSS JOIN (SELECT unnest(range(1, 65)) AS dim)),
r AS (SELECT dim, min(x) AS lo, CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS w FROM p GROUP BY dim)"""


@query(f"WITH {RANGES} SELECT id, dim - 1 AS dim, least(greatest(round((x - lo) / w * 255), 0), 255)::INT AS code FROM p JOIN r USING (dim)")
def quant_scalar(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return quant.scalar_encode(v, quant.train_scalar(v)).select("id", F.posexplode("code").alias("dim", "code")).withColumn("dim", F.col("dim").cast("long"))


@query(f"WITH {VECTORS}, p AS (SELECT dim, e[dim] AS x FROM v CROSS JOIN (SELECT unnest(range(1, 65)) AS dim)), s AS (SELECT dim, x, row_number() OVER (PARTITION BY dim ORDER BY x) - 1 AS rn, count(*) OVER (PARTITION BY dim) AS n FROM p) SELECT dim - 1 AS dim, round(max(CASE WHEN rn = floor((1 - 0.99::DOUBLE) / 2 * n) THEN x END), 6) AS low, round(max(CASE WHEN rn = least(n - 1, floor((1 + 0.99::DOUBLE) / 2 * n)) THEN x END), 6) AS high FROM s GROUP BY dim")
def quant_scalar_quantile(spark, sf_dir):
    codes = quant.train_scalar(vectors(spark, sf_dir), 0.99)
    return rounded(spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(zip(codes.low, codes.high, strict=True))], "dim long, low double, high double"), "low", "high")


@query(SQL["knn_cosine"])
def quant_scalar_search(spark, sf_dir):
    """Rescored with room to spare, the codes give the exact neighbours."""
    v = vectors(spark, sf_dir)
    codes = quant.train_scalar(v)
    found = quant.scalar_search(v, quant.scalar_encode(v, codes), codes, AXIS, 10, options=knn.Quantization(oversampling=5))
    return rounded(found, "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VECTORS}, p AS (SELECT id, dim, e[dim] AS x FROM v CROSS JOIN (SELECT unnest(range(1, 65)) AS dim)), t AS (SELECT dim, avg(x) AS t FROM p GROUP BY dim) SELECT id, sum((x >= t)::INT) AS ones, string_agg((x >= t)::INT::VARCHAR, '' ORDER BY dim) AS bits FROM p JOIN t USING (dim) GROUP BY id")
def quant_binary(spark, sf_dir):
    v = vectors(spark, sf_dir)
    code = quant.binary_encode(v, quant.train_binary(v))
    return code.select("id", F.bit_count(F.col("code")[0]).cast("long").alias("ones"), F.reverse(F.lpad(F.bin(F.col("code")[0]), 64, "0")).alias("bits"))


@query(f"WITH {VECTORS}, b AS (SELECT id, list_transform(e, lambda x: (x >= 0)::INT) AS b FROM v) SELECT x.id AS a, y.id AS b, list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2])))::BIGINT AS hamming FROM b x JOIN b y ON x.id % 50 = 0")
def quant_hamming(spark, sf_dir):
    code = quant.binary_encode(vectors(spark, sf_dir)).persist()
    queries = code.filter(F.col("id") % 50 == 0).select(F.col("id").alias("a"), F.col("code").alias("q"))
    return queries.join(code, F.lit(True)).select("a", F.col("id").alias("b"), quant.hamming(F.col("q"), F.col("code")).cast("long").alias("hamming"))


@query()
def quant_product(spark, sf_dir):
    v = vectors(spark, sf_dir)
    codes = quant.train_product(v, 8, 32)
    return codes.encode(v).select("id", F.concat_ws(",", F.col("code").cast("array<string>")).alias("code"))


@query()
def quant_cells(spark, sf_dir):
    v = vectors(spark, sf_dir)
    cells = quant.train_cells(v, 16)
    return rounded(cells.search(cells.add(v), AXIS, 10, 4), "score")


# --- texts ---


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS hash FROM documents WHERE text IS NOT NULL")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", content_hash(F.col("text")).alias("hash"))


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("chunk_id"), "text")


@query("SELECT conv_id::VARCHAR AS doc_id, turn AS chunk_id, CASE WHEN turn % 5 = 4 THEN 'new' WHEN turn % 5 = 3 THEN 'deleted' WHEN turn % 5 = 2 THEN 'changed' ELSE 'unchanged' END AS status FROM conversations")
def text_diff(spark, sf_dir):
    now = chunks(spark, sf_dir)
    old = extract.chunk_hashes(now.filter("chunk_id % 5 <> 4").withColumn("text", F.when(F.col("chunk_id") % 5 == 2, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))))
    return extract.document_diff(now.filter("chunk_id % 5 <> 3"), old)


@query("WITH t AS (SELECT count(*) AS chunks, sum(ceil(length(coalesce(text, '')) / 4) + 400)::BIGINT AS input_tokens FROM conversations) SELECT chunks, chunks AS missed, input_tokens, least(ceil(input_tokens * 0.4::DOUBLE)::BIGINT, chunks * 1024) AS output_tokens, round((input_tokens * 2.5::DOUBLE + least(ceil(input_tokens * 0.4::DOUBLE), chunks * 1024) * 10) / 1e6, 6) AS dollars, true AS pricing_known FROM t")
def cost_preview(spark, sf_dir):
    return rounded(extract.cost_preview(chunks(spark, sf_dir), "gpt-4o", 1024), "dollars")


@query("SELECT sha256('entity_label' || chr(0) || c_mktsegment || chr(0) || 'doc') AS id, c_mktsegment AS name FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def proposal_ids(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return names.select(F.sha2(F.concat_ws("\0", F.lit("entity_label"), "name", F.lit("doc")), 256).alias("id"), "name")

