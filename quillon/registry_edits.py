"""More queries of the reference operators: edits, imports, collections, extraction, walks with their order, and rank fusion."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import distance as D
from quillon.functions.filters import field, selectivity
from quillon.functions.predicates import Compare, Exists, Label, Negated, Property
from quillon.functions.weights import Temporal, Weight
from quillon.lineage import scratch_folder
from quillon.operators import extract, graph, knn, quant, simgraph, vmath
from quillon.operators.extract import EdgeType, EntityLabel, Ontology
from quillon.plans.hybrid import Rrf, graph_rag
from quillon.registry import (
    _P,
    AS_OF,
    AXIS,
    AXIS_SQL,
    DIST,
    EDGES,
    HOP,
    NODES,
    NOW,
    OTHER,
    OTHER_SQL,
    RANGES,
    SEED,
    SIM,
    UNIT_A,
    UNIT_B,
    VECTORS,
    chunks,
    priced,
    property_graph,
    query,
    rounded,
    start,
    table,
    vectors,
)
from quillon.sources.collection import Catalog, config
from quillon.streaming.ingest import ingest

LAST_ID = 8_000_000_000_000_024


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def property_of(name: str):
    return F.get_json_object("properties", f"$.{name}")


# --- edits of nodes and edges ---


@query(f"WITH {NODES} SELECT id, kind, label, name FROM nodes WHERE label = 'Region' UNION ALL SELECT 50000001, 'entity', 'Club', 'Chess' UNION ALL SELECT 50000002, 'content', NULL, 'Note'")
def node_put(spark, sf_dir):
    g = property_graph(spark, sf_dir).put_node(50_000_001, "entity", "Club", '{"name": "Chess"}', actor="me").put_node(50_000_002, "content", properties='{"name": "Note"}')
    return g.nodes.filter("id >= 40000000").select("id", "kind", "label", property_of("name").alias("name"))


@query(f"WITH {NODES} SELECT id, CASE WHEN id = 30000003 THEN 'X' ELSE name END AS name, CASE WHEN id = 30000003 THEN {NOW} END AS updated_at, CASE WHEN id = 30000003 THEN 'updated' END AS action FROM nodes WHERE label = 'Nation'")
def node_update(spark, sf_dir):
    g = property_graph(spark, sf_dir).update_node(30_000_003, '{"name": "X"}', "me")
    return g.nodes.filter("label = 'Nation'").select("id", property_of("name").alias("name"), "updated_at", F.element_at("history", -1)["action"].alias("action"))


@query(f"WITH {NODES} SELECT id, kind, label, name FROM nodes WHERE id = 30000003")
def node_get(spark, sf_dir):
    return property_graph(spark, sf_dir).get_node(30_000_003).select("id", "kind", "label", property_of("name").alias("name"))


@query("SELECT 9000000000000001 AS id, 30000001 AS source, 40000001 AS target, 'NEAR' AS edge_type, 1.0::DOUBLE AS confidence, true AS is_manual, false AS verified, NULL AS temporal_context, 'created' AS action UNION ALL SELECT 9000000000000002, 30000001, 30000002, 'NEAR', 0.25, true, false, 'now', 'created'")
def edge_put(spark, sf_dir):
    g = property_graph(spark, sf_dir).put_edge(9_000_000_000_000_001, 30_000_001, 40_000_001, "NEAR", confidence=-1.0, temporal_context=" ")
    g = g.put_edge(9_000_000_000_000_002, 30_000_001, 30_000_002, "NEAR", confidence=0.25, temporal_context="now")
    found = g.list_edges(30_000_001, "outgoing", "NEAR")
    return found.select("id", "source", "target", "edge_type", F.col("confidence").cast("double"), "is_manual", "verified", "temporal_context", F.element_at("history", -1)["action"].alias("action"))


@query(f"WITH {EDGES} SELECT id, edge_type FROM edges WHERE source = 30000003 OR target = 30000003")
def edge_list(spark, sf_dir):
    return property_graph(spark, sf_dir).list_edges(30_000_003, "both").select("id", "edge_type")


@query(f"WITH {EDGES} SELECT id, source, target FROM edges WHERE edge_type = 'PART_OF' AND id <> 8000000000000002")
def edge_delete(spark, sf_dir):
    return property_graph(spark, sf_dir).delete_edge(8_000_000_000_000_002).edges.filter("edge_type = 'PART_OF'").select("id", "source", "target")


@query("SELECT 9000000000000001 AS id, 0.5::DOUBLE AS confidence, 5 AS valid_from, NULL::BIGINT AS valid_until, 'b' AS note, 'updated' AS action, 2 AS n_history")
def edge_update(spark, sf_dir):
    g = property_graph(spark, sf_dir).put_edge(9_000_000_000_000_001, 30_000_001, 40_000_001, "NEAR", '{"note": "a"}', valid_from=1, valid_until=9)
    row = g.update_edge(9_000_000_000_000_001, confidence=0.5, valid_from=5, valid_until=None, properties='{"note": "b"}').get_edge(9_000_000_000_000_001)
    return row.select("id", F.col("confidence").cast("double"), "valid_from", "valid_until", property_of("note").alias("note"), F.element_at("history", -1)["action"].alias("action"), F.size("history").cast("long").alias("n_history"))


@query(f"WITH {NODES}, {EDGES} SELECT edge_type, s.name AS source_name, t.name AS target_name, (SELECT count(*) FROM edges) - 1 AS n_edges FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.id = 8000000000000002")
def edge_reject(spark, sf_dir):
    g = property_graph(spark, sf_dir).reject_edge(8_000_000_000_000_002)
    return g.rejects.select("edge_type", "source_name", "target_name").crossJoin(g.edges.agg(F.count(F.lit(1)).alias("n_edges")))


@query(f"WITH {NODES}, {EDGES}, p AS (SELECT e.id, e.edge_type, s.name AS source_name, t.name AS target_name FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.edge_type IN ('LOCATED_IN', 'PART_OF')) SELECT id FROM p WHERE edge_type = 'LOCATED_IN' AND lower(target_name) = 'nation_3' OR edge_type = 'PART_OF' AND lower(source_name) = 'nation_7'")
def edges_rejected(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    names = g.nodes.select(F.col("id").alias("n"), property_of("name").alias("name"))
    edges = g.edges.filter(F.col("edge_type").isin("LOCATED_IN", "PART_OF"))
    for side in ("source", "target"):
        edges = edges.join(names.select(F.col("n").alias(side), F.col("name").alias(f"{side}_name")), side)
    rows = edges.select("id", "edge_type", "source_name", "target_name", F.lit("d").alias("source_doc"), F.lit(1).cast("long").alias("source_chunk_id"))
    rules = spark.createDataFrame([("d", None, "LOCATED_IN", None, "Nation_3"), (None, 1, "PART_OF", "NATION_7", None), ("other", None, "PART_OF", None, None)], graph.REJECTS)
    return extract.rejected(rows, rules).select("id")


# --- import ---

ENDS = "e AS (SELECT s_suppkey AS k, s_suppkey + 20000000 AS s, s_nationkey + 30000000 AS t FROM supplier)"


@query(f"WITH {ENDS} SELECT s AS source, CASE WHEN k % 10 = 1 THEN 99 ELSE t END AS target, CASE WHEN k % 10 = 2 THEN 'OTHER' ELSE 'BASED_IN' END AS edge_type, CASE WHEN k % 10 = 3 THEN NULL ELSE '0.5' END AS confidence FROM e")
def edges_read_csv(spark, sf_dir):
    return graph.read_edge_csv(spark, _csv(spark, sf_dir)).select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "edge_type", "confidence")


def _csv(spark, sf_dir) -> str:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        (k + 20_000_000).alias("source"),
        F.when(k % 10 == 1, 99).otherwise(F.col("s_nationkey") + 30_000_000).alias("target"),
        F.when(k % 10 == 2, "OTHER").otherwise("BASED_IN").alias("edge_type"),
        F.when(k % 10 != 3, "0.5").alias("confidence"),
    )
    folder = f"{scratch_folder(spark)}/edges.csv"
    rows.write.option("header", True).csv(folder)
    return folder


@query(f"WITH {ENDS} SELECT s AS source, t AS target, CASE WHEN k % 10 = 3 THEN 1 ELSE 0.5 END::DOUBLE AS confidence FROM e WHERE k % 10 NOT IN (1, 2)")
def edges_import_csv(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    made, _ = graph.import_edges(graph.read_edge_csv(spark, _csv(spark, sf_dir)), ["BASED_IN"], g.nodes.select("id").filter("id > 10000000"), LAST_ID + 1, NOW)
    return made.select("source", "target", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {ENDS} SELECT CASE k % 10 WHEN 1 THEN 'unknown target 99' ELSE 'unknown edge type OTHER' END AS error, count(*) AS n FROM e WHERE k % 10 IN (1, 2) GROUP BY 1")
def edges_import_errors(spark, sf_dir):
    g = property_graph(spark, sf_dir)
    _, bad = graph.import_edges(graph.read_edge_csv(spark, _csv(spark, sf_dir)), ["BASED_IN"], g.nodes.select("id").filter("id > 10000000"), LAST_ID + 1, NOW)
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENDS} SELECT s AS source, t AS target, CASE WHEN k % 10 = 3 THEN 1 ELSE 0.5 END::DOUBLE AS confidence FROM e WHERE k % 10 NOT IN (1, 2)")
def edges_import_jsonl(spark, sf_dir):
    """An id in quotes is no id, a confidence in quotes is none."""
    k = F.col("s_suppkey")
    source = F.when(k % 10 == 1, F.concat(F.lit('"'), (k + 20_000_000).cast("string"), F.lit('"'))).otherwise((k + 20_000_000).cast("string"))
    line = F.concat(F.lit('{"source": '), source, F.lit(', "target": '), (F.col("s_nationkey") + 30_000_000).cast("string"), F.lit(', "edge_type": "BASED_IN", "confidence": '), F.when(k % 10 == 3, '"0.5"').otherwise("0.5"), F.when(k % 10 == 2, "").otherwise("}"))
    folder = f"{scratch_folder(spark)}/edges.jsonl"
    table(spark, sf_dir, "supplier").select(line.alias("value")).write.text(folder)
    g = property_graph(spark, sf_dir)
    made, _ = graph.import_edges(graph.read_edge_jsonl(spark, folder), ["BASED_IN"], g.nodes.select("id"), LAST_ID + 1, NOW)
    return made.select("source", "target", F.col("confidence").cast("double").alias("confidence"))


# --- collections ---


def _collection(spark, sf_dir, **more):
    """Vectors with their label; ids above 400 are left to be given."""
    rows = vectors(spark, sf_dir).select(F.when(F.col("id") <= 400, F.col("id")).otherwise(F.lit(0)).cast("long").alias("id"), "embedding", F.col("label").cast("long").alias("label"))
    c = Catalog(spark, f"{scratch_folder(spark)}/catalog").create(config("things", 64, **more))
    c.insert(rows)
    return c


INSERTED = f"{VECTORS}, c AS (SELECT id, e, label, 1 AS version FROM v)"


@query(f"WITH {INSERTED} SELECT count(*) AS n, min(id) AS first, max(id) AS last, count(DISTINCT id) AS ids, sum(label)::BIGINT AS labels, round(sum(e[1]), 4) AS x FROM c")
def collection_insert(spark, sf_dir):
    rows = _collection(spark, sf_dir).load()
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("id").alias("ids"), F.sum("label").alias("labels"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("x")
    )


def _changed(spark, sf_dir):
    c = _collection(spark, sf_dir)
    c.update(vectors(spark, sf_dir).filter("id % 7 = 0 and id <= 400").select("id", F.lit(77).cast("long").alias("label")))
    c.update(vectors(spark, sf_dir).filter("id % 14 = 0 and id <= 400").select("id", F.transform("embedding", lambda x: x * 2).alias("embedding")))
    c.delete([1, 3, 399])
    return c


CHANGED = f"{VECTORS}, c AS (SELECT id, round(e[1] * CASE WHEN id % 14 = 0 THEN 2 ELSE 1 END, 6) AS x, CASE WHEN id % 7 = 0 THEN 77 ELSE label END::BIGINT AS label, 1 + (id % 7 = 0)::INT + (id % 14 = 0)::INT AS version FROM v WHERE id <= 400 AND id NOT IN (1, 3, 399))"


@query(f"WITH {CHANGED} SELECT * FROM c")
def collection_changes(spark, sf_dir):
    rows = _changed(spark, sf_dir).load().filter("id <= 400")
    return rows.select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"), "label", F.col("version").cast("int").alias("version"))


@query(f"WITH {CHANGED} SELECT * FROM c")
def collection_compacted(spark, sf_dir):
    c = _changed(spark, sf_dir)
    c.compact(1)
    return c.load().filter("id <= 400").select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"), "label", F.col("version").cast("int").alias("version"))


@query(f"WITH {CHANGED} SELECT 4 AS merged, (SELECT count(*) FROM embeddings) - 3 AS written, 3 + (SELECT count(*) FROM v WHERE id % 7 = 0 AND id <= 400) + (SELECT count(*) FROM v WHERE id % 14 = 0 AND id <= 400) + 3 AS removed")
def collection_compaction(spark, sf_dir):
    done = _changed(spark, sf_dir).compact(1)
    return long(spark.createDataFrame([done]), "merged", "written", "removed")


@query(f"WITH {CHANGED} SELECT id, x, label FROM c WHERE id = 14")
def collection_get(spark, sf_dir):
    row = _changed(spark, sf_dir).get(14)
    return spark.createDataFrame([(row["id"], round(float(row["embedding"][0]), 6), row["label"])], "id long, x double, label long")


@query("SELECT count(*) AS n, true AS same, 'already_optimized' AS second FROM embeddings")
def collection_backup(spark, sf_dir):
    """A backup restored into an empty collection holds the same rows; optimising twice does nothing the second time."""
    c = _collection(spark, sf_dir, quantization="sq8")
    folder = f"{scratch_folder(spark)}/copy"
    c.backup(folder)
    other = c.catalog.create(config("other", 64))
    n = other.restore(folder)
    same = c.load().select("id", "embedding", "label").exceptAll(other.load().select("id", "embedding", "label")).isEmpty()
    c.optimize()
    return spark.createDataFrame([(n, same, c.optimize())], "n long, same boolean, second string")


@query(f"WITH {VECTORS} SELECT id, round(e[1], 6) AS x FROM v")
def collection_stream(spark, sf_dir):
    """A stream taken in twice from one checkpoint adds each row once; rows with an empty vector are left out."""
    folder = scratch_folder(spark)
    c = Catalog(spark, f"{folder}/catalog").create(config("streamed", 64))
    rows = vectors(spark, sf_dir).select(F.col("id").cast("long").alias("id"), "embedding")
    bad = rows.limit(5).select((F.col("id") + 1_000_000).alias("id"), F.array().cast("array<float>").alias("embedding"))
    rows.unionByName(bad).write.parquet(f"{folder}/in")
    for _ in range(2):
        ingest(spark.readStream.schema("id long, embedding array<float>").parquet(f"{folder}/in"), c, f"{folder}/check").awaitTermination()
    return c.load().select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


# --- predicates, filters, search ---

PREDICATES = {
    "not_wrong_type": (Negated(_P("num", "eq", "25")) & Compare(Label(), "eq", "Customer"), "label = 'Customer'"),
    "not_exists": (Negated(Exists(Property("num"))) & Compare(Label(), "ne", "Region"), "num IS NULL AND label <> 'Region'"),
}
for _name, (_predicate, _where) in PREDICATES.items():

    def _predicated(spark, sf_dir, p=_predicate):
        return start(spark, sf_dir).scan(predicate=p).run().select("id")

    _predicated.__name__ = f"predicate_{_name}"
    query(f"WITH {NODES} SELECT id FROM nodes WHERE {_where}")(_predicated)


@query(f"WITH {VECTORS} SELECT v.id, label FROM v JOIN part ON p_partkey + 1 = v.id WHERE p_retailprice BETWEEN 905 AND 930.5")
def filter_between(spark, sf_dir):
    from quillon.functions.filters import compiled

    rows = priced(spark, sf_dir)
    return rows.filter(compiled(field("p_retailprice").between(905, 930.5), rows.schema)).select("id", "label")


@query("SELECT name, share::DOUBLE AS share FROM (VALUES ('eq', 0.25), ('ne', 0.75), ('in', 0.5), ('gt', 0.33), ('between', 0.1), ('contains', 0.1), ('exists', 0.8), ('unknown', 1.0), ('unknown_gt', 0.33), ('and', 0.0825), ('or', 0.4975), ('not', 0.75)) t(name, share)")
def filter_selectivity(spark, sf_dir):
    f = field
    cases = {
        "eq": f("a").eq(1), "ne": f("a").ne(1), "in": f("a").in_([1, 2]), "gt": f("a").gt(1), "between": f("a").between(1, 2), "contains": f("a").contains("x"), "exists": f("a").exists(),
        "unknown": f("b").eq(1), "unknown_gt": f("b").gt(1), "and": f("a").eq(1) & f("a").gt(0), "or": f("a").eq(1) | f("a").gt(0), "not": ~f("a").eq(1),
    }
    return spark.createDataFrame([(n, round(selectivity(e, {"a": 4}, {"a": 80}, 100), 6)) for n, e in cases.items()], "name string, share double")


for _m in ("euclidean", "dot_product", "manhattan"):

    def _batch(spark, sf_dir, m=_m):
        v = vectors(spark, sf_dir)
        queries = v.filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
        return long(rounded(knn.batch_search(v, queries, 10, m), "score").withColumn("score", F.col("score") + 0.0), "rank")

    _batch.__name__ = f"knn_batch_{_m}"
    _d = DIST[_m].format(q="b.e").replace("(e, b.e)", "(a.e, b.e)")
    query(f"WITH {VECTORS}, d AS (SELECT a.id AS qid, b.id, {_d} AS d FROM v a CROSS JOIN v b WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM d) SELECT qid, id, round(d, 6) + 0.0 AS score, rank FROM r WHERE rank <= 10")(_batch)


@query(f"WITH {SIM}, top AS (SELECT v.id, row_number() OVER (ORDER BY list_cosine_distance(e, {AXIS_SQL}), v.id) AS rank FROM v QUALIFY rank <= 5), r AS (SELECT id, rank, dst, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, dst) AS n FROM top LEFT JOIN (SELECT * FROM sim WHERE similarity >= 0.35) ON src = id) SELECT id, rank, dst AS neighbour, round(similarity, 6) AS similarity FROM r WHERE n <= 3")
def search_with_graph(spark, sf_dir):
    """Search results with their edges of the similarity graph, at most three each."""
    v = vectors(spark, sf_dir)
    found = knn.with_graph(knn.search(v, AXIS, 5), simgraph.build(v, 0.3), most=3, threshold=0.35)
    rows = found.select("id", "rank", F.explode_outer("graph_edges").alias("e")).select("id", "rank", F.col("e.target").alias("neighbour"), F.col("e.similarity").alias("similarity"))
    return long(rounded(rows, "similarity"), "rank")


@query(f"WITH {VECTORS}, n AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS n FROM v) SELECT id, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS squared FROM n")
def normalized_strictly(spark, sf_dir):
    unit = vectors(spark, sf_dir).select("id", D.normalized(F.col("embedding"), strict=True).alias("u"))
    return unit.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


# --- graph with order ---


@query(f"WITH {EDGES}, b AS (SELECT source AS node, target AS neighbour, 0 AS side, id FROM edges WHERE edge_type = 'LOCATED_IN' UNION ALL SELECT target, source, 1, id FROM edges WHERE edge_type = 'LOCATED_IN'), f AS (SELECT node, neighbour, min((side, id)) AS o FROM b GROUP BY 1, 2) SELECT node, neighbour, row_number() OVER (PARTITION BY node ORDER BY o) - 1 AS pos FROM f")
def graph_neighbours_in_order(spark, sf_dir):
    return graph.neighbours(property_graph(spark, sf_dir).edges, "both", "LOCATED_IN")


@query(f"WITH {EDGES}, w AS (SELECT *, greatest(coalesce(qty, 1), 1e-6) AS w FROM edges) SELECT source AS node, target AS neighbour, round(max(w), 6) AS weight FROM w WHERE valid_from <= {AS_OF} AND {AS_OF} < valid_until GROUP BY 1, 2")
def temporal_weighted_neighbours(spark, sf_dir):
    found = graph.weighted_neighbours(property_graph(spark, sf_dir).edges, Weight("qty"), NOW, temporal=Temporal(AS_OF, False))
    return rounded(found, "weight")


def _level(name: str, before: str, seen: str, keep: str = "") -> str:
    """CTEs of one level of a k-hop walk: nodes first seen from the level before, numbered in the order of (parent, edge), then those that pass."""
    return f"""{name}_f AS (SELECT e.target AS id, min((b.pos, e.id)) AS o FROM {before} b JOIN edges e ON e.source = b.id WHERE e.target NOT IN ({seen}) GROUP BY e.target),
{name}_n AS (SELECT id, row_number() OVER (ORDER BY o) - 1 AS pos FROM {name}_f),
{name} AS (SELECT n.id, n.pos FROM {name}_n n {keep})"""


@query(f"WITH {VECTORS}, {SEED}, {EDGES}, {_level('l1', 's', 'SELECT id FROM s')}, {_level('l2', 'l1', 'SELECT id FROM s UNION SELECT id FROM l1')}, {_level('l3', 'l2', 'SELECT id FROM s UNION SELECT id FROM l1 UNION SELECT id FROM l2')}, u AS (SELECT id, 1 AS step, pos FROM l1 UNION ALL SELECT id, 2, pos FROM l2 UNION ALL SELECT id, 3, pos FROM l3) SELECT id, row_number() OVER (ORDER BY step, pos) - 1 AS pos FROM u")
def hybrid_k_hop_in_order(spark, sf_dir):
    return start(spark, sf_dir).vector_similar(AXIS, 20).k_hop(3).run().select("id", "pos")


_RICH = "JOIN nodes k ON k.id = n.id WHERE k.num > 3000"


@query(f"WITH {VECTORS}, {SEED}, {EDGES}, {NODES}, {_level('l1', 's', 'SELECT id FROM s', _RICH)}, {_level('l2', 'l1', 'SELECT id FROM s UNION SELECT id FROM l1', _RICH)}, u AS (SELECT id, 1 AS step, pos FROM l1 UNION ALL SELECT id, 2, pos FROM l2) SELECT id, row_number() OVER (ORDER BY step, pos) - 1 AS pos FROM u")
def hybrid_k_hop_predicate_in_order(spark, sf_dir):
    return start(spark, sf_dir).vector_similar(AXIS, 20).k_hop(2, predicate=_P("num", "gt", 3000)).run().select("id", "pos")


@query(f"""WITH {NODES}, {EDGES}, s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM nodes WHERE label = 'Customer' AND num > 9000),
w AS (SELECT source, target, max(greatest(coalesce(qty, 1) * least(greatest(conf::FLOAT::DOUBLE, 0), 1), 1e-6)) AS w FROM edges GROUP BY 1, 2),
a AS (SELECT w.target AS id, pos, w.w AS p FROM s JOIN w ON w.source = s.id), a1 AS (SELECT id, max(p) AS acc, arg_min(p, pos) AS first FROM a GROUP BY id),
b AS (SELECT w.target AS id, max(a1.first * w.w) AS acc FROM a1 JOIN w ON w.source = a1.id WHERE w.target NOT IN (SELECT id FROM s) GROUP BY 1),
u AS (SELECT id, max(acc) AS acc FROM (SELECT id, acc FROM a1 UNION ALL SELECT * FROM b) GROUP BY id) SELECT id, row_number() OVER (ORDER BY acc DESC, id) - 1 AS pos FROM u""")
def hybrid_k_hop_by_weight(spark, sf_dir):
    return start(spark, sf_dir).scan(True, "Customer", _P("num", "gt", 9000)).k_hop(2, weight=Weight("qty", True), order_by_weight=True).run()


@query("SELECT 0 AS pos, unnest([0, 1, 2])::INT AS at, unnest([10000001, 30000000 + c_nationkey, 40000000 + n_regionkey]) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def hybrid_cheapest_path(spark, sf_dir):
    from quillon.registry import region_of

    path = start(spark, sf_dir).from_nodes([10_000_001]).shortest_path(region_of(spark, sf_dir), ["LOCATED_IN", "PART_OF"], Weight("qty")).return_paths()
    return path.select("pos", F.posexplode("nodes").alias("at", "id"))


@query(f"WITH {EDGES} SELECT DISTINCT a.target AS id FROM edges a JOIN edges b ON a.target = b.target WHERE a.source IN (10000001, 10000004) AND b.source IN (10000001, 10000004) AND a.source < b.source UNION SELECT DISTINCT c.id FROM (SELECT target AS id FROM edges WHERE source = 30000001 UNION SELECT source FROM edges WHERE target = 30000001) c JOIN (SELECT target AS id FROM edges WHERE source = 30000001 UNION SELECT source FROM edges WHERE target = 30000001) d USING (id)")
def hybrid_mutual_neighbours(spark, sf_dir):
    s = start(spark, sf_dir)
    one = s.from_nodes([10_000_001]).mutual_neighbours(s.from_nodes([10_000_004]))
    return one.union(s.from_nodes([30_000_001]).mutual_neighbours(s.from_nodes([30_000_001]))).run().select("id")


RRF = f"""WITH {HOP}, pool AS (SELECT id, pos FROM s UNION ALL SELECT id, 20 + row_number() OVER (ORDER BY o) - 1 FROM h WHERE id NOT IN (SELECT id FROM s)),
r1 AS (SELECT p.id, row_number() OVER (ORDER BY list_cosine_distance(v.e, {AXIS_SQL}), p.id) AS r FROM pool p JOIN v ON v.id = p.id),
n AS (SELECT e.target AS id, {{near}} AS near FROM edges e JOIN pool p ON p.id = e.target {{join}} WHERE e.source IN (SELECT id FROM s) AND e.target NOT IN (SELECT id FROM s) GROUP BY 1),
r2 AS (SELECT n.id, row_number() OVER (ORDER BY near DESC, pos) AS r FROM n JOIN pool USING (id)),
f AS (SELECT id, pos, coalesce(1 / (60::DOUBLE + r1.r), 0) + coalesce(1 / (60::DOUBLE + r2.r), 0) AS score FROM pool LEFT JOIN r1 USING (id) LEFT JOIN r2 USING (id))
SELECT id, row_number() OVER (ORDER BY score DESC, pos) - 1 AS pos, round(score, 6) AS score FROM f QUALIFY pos < 15"""


@query(RRF.format(near="count(DISTINCT e.source)", join="").replace("QUALIFY pos < 15", "QUALIFY row_number() OVER (ORDER BY f.score DESC, f.pos) <= 15"))
def hybrid_rank_fusion(spark, sf_dir):
    s = start(spark, sf_dir)
    seeds = s.vector_similar(AXIS, 20)
    return rounded(seeds.union(seeds.traverse("SUPPLIED_BY")).fused(Rrf(k=60, max_hops=1), 15), "score")


@query(
    RRF.format(near="count(DISTINCT e.source) / (1 + 0.5::DOUBLE * ln(1 + max(d.degree)))", join="JOIN (SELECT n, count(*) AS degree FROM (SELECT source AS n, id FROM edges UNION SELECT target, id FROM edges) GROUP BY n) d ON d.n = e.target").replace(
        "QUALIFY pos < 15", "QUALIFY row_number() OVER (ORDER BY f.score DESC, f.pos) <= 15"
    )
)
def hybrid_rank_fusion_damped(spark, sf_dir):
    s = start(spark, sf_dir)
    seeds = s.vector_similar(AXIS, 20)
    return rounded(seeds.union(seeds.traverse("SUPPLIED_BY")).fused(Rrf(k=60, max_hops=1, hub_damping=0.5), 15), "score")


NEAR_OTHER = SEED.replace(AXIS_SQL, OTHER_SQL)


@query(f"WITH {VECTORS}, {NEAR_OTHER}, {EDGES}, p AS (SELECT id FROM s UNION SELECT target FROM s JOIN edges e ON e.source = s.id WHERE edge_type = 'SUPPLIED_BY' UNION SELECT source FROM s JOIN edges e ON e.target = s.id WHERE edge_type = 'SUPPLIED_BY') SELECT v.id, row_number() OVER (ORDER BY list_cosine_distance(e, {OTHER_SQL}), v.id) - 1 AS pos FROM v JOIN p ON p.id = v.id QUALIFY pos < 10")
def hybrid_graph_rag(spark, sf_dir):
    """Nearest vectors and what a relation ties them to, ranked together."""
    return graph_rag(start(spark, sf_dir), OTHER, 10, seeds=20, relations=["SUPPLIED_BY"]).select("id", "pos")


# --- similarity graph ---

WALK = f"""{SIM}, k AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 50), g AS (SELECT * FROM k WHERE similarity >= 0.35),
w1 AS (SELECT dst AS id, 1 AS depth, similarity AS p, row_number() OVER (ORDER BY similarity DESC, dst) AS pos, [1, dst] AS path FROM g WHERE src = 1),
w2o AS (SELECT g.dst AS id, min((w1.pos, -g.similarity, g.src)) AS o FROM w1 JOIN g ON g.src = w1.id WHERE g.dst <> 1 AND g.dst NOT IN (SELECT id FROM w1) GROUP BY g.dst),
w2 AS (SELECT w2o.id, 2 AS depth, w1.p * g.similarity AS p, list_append(w1.path, w2o.id) AS path FROM w2o JOIN w1 ON w1.id = o[3] JOIN g ON g.src = w1.id AND g.dst = w2o.id),
walk AS (SELECT id, depth, path, p FROM w1 UNION ALL SELECT id, depth, path, p FROM w2)"""


@query(f"WITH {WALK} SELECT id, depth::INT AS depth, array_to_string(path, ',') AS path, round(p, 6) AS path_similarity FROM walk")
def similarity_walk(spark, sf_dir):
    found = simgraph.traverse(simgraph.build(vectors(spark, sf_dir), 0.3).persist(), 1, 2, 0.35)
    return rounded(found, "path_similarity").withColumn("path", F.concat_ws(",", F.col("path").cast("array<string>")))


@query(f"WITH {WALK} SELECT id, round(p, 6) AS path_similarity FROM walk WHERE p >= 0.2 ORDER BY p DESC, id LIMIT 5")
def similarity_relationships(spark, sf_dir):
    return rounded(simgraph.relationships(simgraph.build(vectors(spark, sf_dir), 0.3).persist(), 1, 2, 0.35, 0.2, 5), "path_similarity").select("id", "path_similarity")


@query(f"WITH {WALK}, t AS (SELECT path FROM walk WHERE depth = (SELECT max(depth) FROM walk) ORDER BY id LIMIT 1) SELECT unnest(range(0, len(path)))::INT AS at, unnest(path) AS id FROM t")
def similarity_path(spark, sf_dir):
    edges = simgraph.build(vectors(spark, sf_dir), 0.3).persist()
    walk = simgraph.traverse(edges, 1, 2, 0.35)
    end = walk.filter(F.col("depth") == walk.agg(F.max("depth")).first()[0]).agg(F.min("id")).first()[0]
    path = simgraph.find_path(edges, 1, end, 2, 0.35) if end is not None else []
    return spark.createDataFrame(list(enumerate(path)), "at int, id long")


@query(f"WITH {SIM}, k AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 50), p AS (SELECT src AS b, min(dst) AS m FROM k WHERE src > 1 GROUP BY src) SELECT DISTINCT x.dst AS id FROM k x JOIN k y ON x.dst = y.dst WHERE x.src = 2 AND y.src = (SELECT min(z.src) FROM k z JOIN k o ON o.dst = z.dst WHERE o.src = 2 AND z.src > 2)")
def similarity_mutual(spark, sf_dir):
    edges = simgraph.build(vectors(spark, sf_dir), 0.3).persist()
    near = edges.filter("src = 2").select("dst")
    other = edges.join(near, "dst", "left_semi").filter("src > 2").agg(F.min("src")).first()[0]
    return simgraph.mutual(edges, 2, other, 0.3)


@query(f"WITH {SIM}, k AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 50) SELECT src, dst FROM k WHERE least(src, dst) % 5 = 0 OR similarity >= 0.4")
def similarity_pruned(spark, sf_dir):
    """Vectors whose id is divisible by five have a threshold of their own and keep their edges."""
    v = vectors(spark, sf_dir)
    own = v.filter("id % 5 = 0").select("id", F.lit(0.9).alias("threshold_override"))
    return simgraph.pruned(simgraph.build(v, 0.3), 0.4, own).select("src", "dst")


@query(f"WITH {VECTORS} SELECT id, CASE WHEN id % 5 = 0 THEN 0.9 ELSE 0.4 END::DOUBLE AS threshold FROM v")
def similarity_thresholds(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return simgraph.resolved_threshold(v.filter("id % 5 = 0").select("id", F.lit(0.9).alias("threshold_override")), v, 0.4, 0.7)


# --- vector mathematics and codes ---


@query(f"WITH {VECTORS}, m AS (SELECT dim, sum(e[dim]) AS s, count(*) AS n, max(CASE WHEN id = 1 THEN e[dim] END) AS x FROM v CROSS JOIN (SELECT unnest(range(1, 65)) AS dim) GROUP BY dim) SELECT dim - 1 AS dim, round((s + x) / (n + 1), 6) AS more, round((s - x) / (n - 1), 6) AS less FROM m")
def math_centroid_updates(spark, sf_dir):
    v = vectors(spark, sf_dir)
    row, one = vmath.centroid_table(v).first(), v.filter("id = 1").first()["embedding"]
    more, less = vmath.centroid_with(row["centroid"], row["n"], one), vmath.centroid_without(row["centroid"], row["n"], one)
    return spark.createDataFrame([(k, round(a, 6), round(b, 6)) for k, (a, b) in enumerate(zip(more, less, strict=True))], "dim long, more double, less double")


@query(f"SELECT i AS n, dim - 1 AS dim, round(a[dim] + i / 4::DOUBLE * (b[dim] - a[dim]), 6) AS x FROM (SELECT {UNIT_A}::DOUBLE[] AS a, {UNIT_B}::DOUBLE[] AS b), (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(1, 65)) AS dim)")
def math_sequence(spark, sf_dir):
    return spark.createDataFrame([(i, k, round(x, 6)) for i, point in enumerate(vmath.sequence(UNIT_A, UNIT_B, 5)) for k, x in enumerate(point)], "n long, dim long, x double")


@query(f"WITH {RANGES} SELECT id, dim - 1 AS dim, round(least(greatest(round((x - lo) / w * 255), 0), 255) / 255 * w + lo, 5) AS x FROM p JOIN r USING (dim)")
def quant_scalar_decoded(spark, sf_dir):
    v = vectors(spark, sf_dir)
    codes = quant.train_scalar(v)
    back = quant.scalar_decode(quant.scalar_encode(v, codes), codes)
    return back.select("id", F.posexplode("embedding").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


@query(f"WITH {RANGES}, d AS (SELECT id, dim, least(greatest(round((x - lo) / w * 255), 0), 255) / 255 * w + lo AS y FROM p JOIN r USING (dim)), a AS (SELECT dim, ({AXIS_SQL})[dim] AS q FROM (SELECT unnest(range(1, 65)) AS dim)) SELECT id, round(sqrt(sum((y - q) * (y - q))), 5) AS euclidean, round(1 - sum(y * q) / (sqrt(sum(y * y)) * sqrt(sum(q * q))), 5) AS cosine FROM d JOIN a USING (dim) GROUP BY id")
def quant_scalar_distances(spark, sf_dir):
    v = vectors(spark, sf_dir)
    codes = quant.train_scalar(v)
    both = [F.round(quant.scalar_distance(codes, D.vector(AXIS), F.col("code"), m), 5).alias(m) for m in ("euclidean", "cosine")]
    return quant.scalar_encode(v, codes).select("id", *both)


@query(f"WITH {RANGES}, d AS (SELECT id, dim, least(greatest(round((x - lo) / w * 255), 0), 255) / 255 * w + lo AS y FROM p JOIN r USING (dim) WHERE id % 3 = 0), a AS (SELECT dim, ({AXIS_SQL})[dim] AS q FROM (SELECT unnest(range(1, 65)) AS dim)), s AS (SELECT id, sqrt(sum((y - q) * (y - q))) AS score FROM d JOIN a USING (dim) GROUP BY id) SELECT id, round(score, 5) AS score, row_number() OVER (ORDER BY round(score, 9), id) AS rank FROM s QUALIFY rank <= 10")
def quant_scalar_search_among(spark, sf_dir):
    """Candidates only, ranked by the codes' own distance."""
    v = vectors(spark, sf_dir)
    codes = quant.train_scalar(v)
    found = quant.scalar_search_among(v, quant.scalar_encode(v, codes), codes, AXIS, 10, v.filter("id % 3 = 0").select("id"), "euclidean", rescore=False)
    return long(found.withColumn("score", F.round("score", 5)), "rank")


@query(f"WITH {VECTORS}, b AS (SELECT id, list_transform(e, lambda x: (x >= 0)::INT) AS b FROM v), h AS (SELECT y.id, list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2])))::BIGINT AS h FROM b x JOIN b y ON x.id = 1) SELECT id, h AS hamming, round(h / 64::DOUBLE, 6) AS share, round(2 * h / 64::DOUBLE, 6) AS cosine FROM h")
def quant_hamming_estimates(spark, sf_dir):
    code = quant.binary_encode(vectors(spark, sf_dir))
    one = F.broadcast(code.filter("id = 1").select(F.col("code").alias("q")))
    both = code.crossJoin(one)  # one row
    return both.select("id", quant.hamming(F.col("q"), F.col("code")).cast("long").alias("hamming"), F.round(quant.hamming_share(F.col("q"), F.col("code"), 64), 6).alias("share"), F.round(quant.hamming_cosine(F.col("q"), F.col("code"), 64), 6).alias("cosine"))


# --- extraction ---


@query("SELECT p_partkey, lower(rtrim(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), '.,;:')) AS name FROM part")
def entity_names(spark, sf_dir):
    from quillon.functions.text import normalized_name

    return table(spark, sf_dir, "part").select("p_partkey", normalized_name("p_name").alias("name"))


@query("WITH p AS (SELECT DISTINCT lower(p_brand) AS a FROM part) SELECT x.a, y.a AS b FROM p x JOIN p y ON x.a < y.a AND levenshtein(x.a, y.a) <= CASE WHEN least(length(x.a), length(y.a)) <= 4 THEN 0 WHEN least(length(x.a), length(y.a)) <= 8 THEN 1 ELSE 2 END")
def entity_few_edits(spark, sf_dir):
    """Candidates meet by block keys, then the rule is applied."""
    from quillon.functions.text import few_edits, keys_of, probes_of

    p = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("a")).distinct()
    one = p.select("a", F.explode(probes_of("a")).alias("key"))
    two = p.select(F.col("a").alias("b"), F.explode(keys_of("a")).alias("key"))
    met = one.join(two, "key").select("a", "b").distinct().filter(few_edits(F.col("a"), F.col("b")) & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query("SELECT c_custkey AS name_id, c_custkey + 10000000 AS id FROM customer")
def entity_exact(spark, sf_dir):
    """Names in other letters and white space find their nodes."""
    g = property_graph(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name_id"), F.lit("Customer").alias("label"), F.concat(F.lit("  "), F.upper("c_name"), F.lit(".")).alias("name"))
    return extract.exact_matches(names, g.nodes)


@query("WITH d AS (SELECT n_regionkey::VARCHAR AS d, min(n_nationkey) + 60000000 AS c FROM nation GROUP BY 1), p AS (SELECT * FROM (VALUES ('entity_label', 'Club'), ('entity_label', 'Unknown'), ('edge_type', 'PLAYS_IN'), ('edge_type', 'UNKNOWN')) t(kind, name)) SELECT sha256(kind || chr(0) || name || chr(0) || d) AS id, kind, name, 'pending' AS status, d AS source_doc, c AS source_chunk_id FROM d CROSS JOIN p")
def extract_proposals(spark, sf_dir):
    found = extract.extracted(_nation_chunks(spark, sf_dir), Parsed(), ONTOLOGY)
    return extract.proposals(found, Ontology((EntityLabel("Nation"), EntityLabel("Region")), (EdgeType("PART_OF"), EdgeType("SAID_IN")))).select("id", "kind", "name", "status", "source_doc", "source_chunk_id")


class Parsed:
    """An adapter whose answer is the chunk's own JSON; a chunk that isn't JSON fails."""

    model, max_tokens = "gpt-4o", 1024

    def extract(self, text, ontology, prompt_version):
        return json.loads(text)


ONTOLOGY = Ontology((EntityLabel("Nation"), EntityLabel("Region"), EntityLabel("Club")), (EdgeType("PART_OF"), EdgeType("PLAYS_IN"), EdgeType("SAID_IN")))


def _nation_chunks(spark, sf_dir) -> DataFrame:
    """A chunk for each nation, a document for each region."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entity = lambda ref, label, name: F.struct(F.lit(ref).alias("ref"), F.lit(label).alias("label"), name.alias("name"))
    edge = lambda a, b, kind: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(kind).alias("edge_type"))
    entities = F.array(entity("n", "Nation", F.upper("n_name")), entity("r", "Region", F.col("r_name")), entity("c", "Club", F.concat(F.lit("Club of "), F.col("n_name"))), entity("x", "Unknown", F.lit("x")))
    edges = F.array(edge("n", "r", "PART_OF"), edge("c", "n", "PLAYS_IN"), edge("n", "@chunk", "SAID_IN"), edge("n", "x", "PART_OF"), edge("n", "r", "UNKNOWN"))
    return rows.select(F.col("n_regionkey").cast("string").alias("doc_id"), (F.col("n_nationkey") + 60_000_000).cast("long").alias("chunk_id"), F.to_json(F.struct(entities.alias("entities"), edges.alias("edges"))).alias("text"))


def _processed(spark, sf_dir) -> graph.Graph:
    rows = _nation_chunks(spark, sf_dir)
    return extract.process_chunks(property_graph(spark, sf_dir), extract.extracted(rows, Parsed(), ONTOLOGY), ONTOLOGY, chunks=rows)


CLUBS = f"club AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name, {LAST_ID} + row_number() OVER (ORDER BY n_regionkey::VARCHAR, n_nationkey) AS id FROM nation)"


@query(f"WITH {CLUBS}, e AS (SELECT k, r, 0 AS place, 30000000 + k AS source, 40000000 + r AS target, 'PART_OF' AS edge_type FROM club UNION ALL SELECT k, r, 1, id, 30000000 + k, 'PLAYS_IN' FROM club UNION ALL SELECT k, r, 2, 30000000 + k, 60000000 + k, 'SAID_IN' FROM club) SELECT (SELECT max(id) FROM club) + row_number() OVER (ORDER BY r::VARCHAR, k, place) AS id, source, target, edge_type, r::VARCHAR AS source_doc, 60000000 + k AS source_chunk_id FROM e")
def extract_process_exact(spark, sf_dir):
    """Nations and regions resolve to their nodes, clubs are made, passages get content nodes, unknown labels and types are left out."""
    edges = _processed(spark, sf_dir).edges.filter("provenance.source_doc is not null")
    return edges.select("id", "source", "target", "edge_type", "provenance.source_doc", "provenance.source_chunk_id")


@query(f"WITH {CLUBS} SELECT id, 'entity' AS kind, 'Club' AS label, 'Club of ' || n_name AS name, 'club of ' || lower(n_name) AS name_norm, NULL AS doc_id FROM club UNION ALL SELECT 60000000 + k, 'content', NULL, NULL, NULL, r::VARCHAR FROM club")
def extract_process_nodes(spark, sf_dir):
    nodes = _processed(spark, sf_dir).nodes.filter("source = 'extracted'")
    return nodes.select("id", "kind", "label", *[property_of(x).alias(x) for x in ("name", "name_norm", "doc_id")])


@query("SELECT conv_id::VARCHAR AS doc_id, turn AS chunk_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g')) || chr(0) || 'gpt-4o' || chr(0) || '7') AS cache_key FROM conversations")
def extract_cache_keys(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    return extract.cache_keys(rows, "gpt-4o", "7", Ontology()).select("doc_id", "chunk_id", "cache_key")


@query("SELECT 'changed' AS status, count(*) FILTER (n_nationkey % 5 = 2) AS n FROM nation UNION ALL SELECT 'deleted', count(*) FILTER (n_nationkey % 5 = 3) FROM nation UNION ALL SELECT 'new', count(*) FILTER (n_nationkey % 5 = 4) FROM nation UNION ALL SELECT 'unchanged', count(*) FILTER (n_nationkey % 5 < 2) FROM nation UNION ALL SELECT 'edges', count(*) FILTER (n_nationkey % 5 IN (2, 4)) * 3 FROM nation UNION ALL SELECT 'hashes', count(*) FILTER (n_nationkey % 5 <> 3) FROM nation")
def extract_again(spark, sf_dir):
    """Documents after a change: counts by status, edges made, hashes kept."""
    now = _nation_chunks(spark, sf_dir)
    k = F.col("chunk_id") % 5
    old = extract.chunk_hashes(now.filter(k != 4).withColumn("text", F.when(k == 2, F.concat("text", F.lit(" "), F.lit("old"))).otherwise(F.col("text"))))
    made, hashes, counts, _ = extract.re_extract(property_graph(spark, sf_dir), now.filter(k != 3), old, Parsed(), ONTOLOGY)
    rows = [*counts.items(), ("edges", made.edges.filter("provenance.source_doc is not null").count()), ("hashes", hashes.count())]
    return spark.createDataFrame(rows, "status string, n long")


@query("SELECT n_regionkey::VARCHAR AS doc_id, CASE WHEN max((n_nationkey % 7 = 3)::INT) = 1 THEN 'failed' ELSE 'completed' END AS status FROM nation GROUP BY 1")
def extract_corpus_again(spark, sf_dir):
    """A document with a chunk that fails is failed, the others are completed."""
    rows = _nation_chunks(spark, sf_dir).withColumn("text", F.when((F.col("chunk_id") - 60_000_000) % 7 == 3, F.lit("no JSON")).otherwise(F.col("text")))
    empty = spark.createDataFrame([], extract.CHUNK_HASHES)
    _, _, manifest, _ = extract.re_extract_corpus(property_graph(spark, sf_dir), rows, empty, Parsed(), ONTOLOGY)
    return manifest


@query("SELECT 'completed_with_errors' AS status, count(*) AS total, count(*) FILTER (n_nationkey % 7 <> 3) AS done, count(*) FILTER (n_nationkey % 7 = 3) AS failed FROM nation")
def extract_job_status(spark, sf_dir):
    rows = _nation_chunks(spark, sf_dir).withColumn("text", F.when((F.col("chunk_id") - 60_000_000) % 7 == 3, F.lit("no JSON")).otherwise(F.col("text")))
    job = extract.job_status(extract.extracted(rows, Parsed(), ONTOLOGY))
    return spark.createDataFrame([(job.status, job.total, job.done, job.failed)], "status string, total long, done long, failed long")


@query("SELECT model, input::DOUBLE AS input, output::DOUBLE AS output, known FROM (VALUES ('gpt-4o-mini', 0.15, 0.6, true), ('gpt-4o', 2.5, 10.0, true), ('gpt-4-turbo', 10.0, 30.0, true), ('gpt-3.5-turbo', 0.5, 1.5, true), ('other', 0.0, 0.0, false)) t(model, input, output, known)")
def cost_prices(spark, sf_dir):
    known = [(m, *extract.PRICES.get(m, (0.0, 0.0)), m in extract.PRICES) for m in ("gpt-4o-mini", "gpt-4o", "gpt-4-turbo", "gpt-3.5-turbo", "other")]
    return spark.createDataFrame(known, T.StructType.fromDDL("model string, input double, output double, known boolean"))
