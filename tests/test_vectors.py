import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import distance as D
from quillon.functions.filters import And, Leaf, Or, compiled, field, fields, parsed, selectivity
from quillon.operators import knn, quant, simgraph, vmath


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = [(i + 1, [float(v) for v in r], i % 5, f"n{i % 3}") for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, embedding array<float>, label int, name string").persist()


def test_distances_of_edge_cases(spark):
    row = spark.range(1).select(
        D.cosine_distance(D.vector([0, 0]), D.vector([1, 0])).alias("zero"),
        D.euclidean_distance(D.vector([0, 3]), D.vector([4, 0])).alias("l2"),
        D.dot_product_distance(D.vector([1, 2]), D.vector([3, 4])).alias("dot"),
        D.manhattan_distance(D.vector([1, 2]), D.vector([3, -4])).alias("l1"),
        D.normalized(D.vector([0, 0])).alias("still"),
        D.similarity(F.lit(3.0), "euclidean").alias("sim"),
    ).first()
    assert (row["zero"], row["l2"], row["dot"], row["l1"], row["still"], row["sim"]) == (1.0, 5.0, -11.0, 8.0, [0.0, 0.0], 0.25)
    assert D.metric_named("DotProduct") == "dot_product" and D.metric_named("x") is None
    with pytest.raises(Exception, match="zero vector"):
        spark.range(1).select(D.normalized(D.vector([0, 0]), strict=True)).collect()
    with pytest.raises(Exception, match="finite"):
        spark.range(1).select(D.checked(D.vector([1, float("nan")]), 2)).collect()


@pytest.mark.parametrize("metric", D.METRICS)
def test_batch_search_is_exact(spark, points, metric):
    x, df = points
    queries = df.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
    got = {}
    for r in knn.batch_search(df, queries, 5, metric).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    full = D.pairwise(x, x, metric)
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == (np.lexsort((np.arange(200), full[q - 1]))[:5] + 1).tolist()
    assert len(got) == 10
    one = [r["id"] for r in knn.search(df, x[19].tolist(), 5, metric).orderBy("rank").collect()]
    assert one == [i for _, i in sorted(got[20])]


def test_batch_search_ties_nulls_and_empty(spark):
    rows = [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, query array<float>")
    assert [(r["id"], r["rank"]) for r in knn.batch_search(df, q, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert knn.batch_search(df, q.limit(0), 2).count() == 0
    assert knn.batch_search(df.limit(0), q, 2).count() == 0


def test_strategies(points):
    x, df = points
    where = field("label").eq(1)
    pre = knn.filtered_search(df, x[0].tolist(), 10, where, "pre_filter")
    assert pre.count() == 10
    post = knn.filtered_search(df, x[0].tolist(), 10, where, "post_filter")
    assert post.count() <= 10
    assert knn.oversampling(0) == 20 and knn.oversampling(0.5) == 3 and knn.oversampling(0.1) == 10
    assert 0 < knn.assumed_share(df, where, ["label"]) <= 1
    knn.check_ef(None)
    with pytest.raises(ValueError):
        knn.check_ef(10_001)


def test_filters_have_two_values(spark):
    rows = [(1, 5, 1.5, "abc", True, ["x", "y"]), (2, None, float("nan"), None, None, None), (3, -1, None, "ab", False, [])]
    df = spark.createDataFrame(rows, "id long, i int, f double, s string, b boolean, l array<string>")

    def ids(f):
        return [r["id"] for r in df.filter(compiled(f, df.schema)).orderBy("id").collect()]

    assert ids(field("i").ne(5)) == [3]
    assert ids(~field("i").ne(5)) == [1, 2]
    assert ids(field("i").eq(5.0)) == [1]
    assert ids(field("i").eq("5")) == [] and ids(field("i").ne("5")) == [1, 3]
    assert ids(field("f").gt(0)) == [1]
    assert ids(field("b").gt(False)) == []
    assert ids(field("s").contains("bc")) == [1] and ids(field("l").contains("y")) == [1]
    assert ids(field("none").exists()) == [] and ids(~field("none").exists()) == [1, 2, 3]
    assert ids(And()) == [1, 2, 3] and ids(Or()) == []
    assert ids(parsed({"field": "i", "op": "in", "values": []})) == []
    assert ids(parsed({"field": "i", "op": "between", "values": [-1, 5]})) == [1, 3]
    assert fields(field("a").eq(1) & ~field("b").eq(2) | field("a").exists()) == ["a", "b"]
    for bad in ({"field": "a", "op": "like", "value": 1}, {"field": "a", "op": "between", "values": [1]}, {"field": "a", "op": "contains", "value": 1}, {}):
        with pytest.raises(ValueError):
            parsed(bad)
    assert selectivity(Leaf("a", "eq", 1), {"a": 4}, {"a": 10}, 10) == 0.25


def test_similarity_graph(points):
    x, df = points
    edges = simgraph.build(df, 0.2).persist()
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    assert pairs and all((b, a) in pairs for a, b in pairs) and all(a != b for a, b in pairs)
    start = next(iter(pairs))[0]
    found = simgraph.traverse(edges, start, 2, 0.2).collect()
    assert all(r["path"][0] == start and r["path"][-1] == r["id"] and len(r["path"]) == r["depth"] + 1 for r in found)
    assert [r["path_similarity"] for r in found] == sorted((r["path_similarity"] for r in found), reverse=True)
    end = found[-1]["id"]
    assert len(simgraph.find_path(edges, start, end, 2, 0.2)) == found[-1]["depth"] + 1
    assert simgraph.find_path(edges, start, start, 2, 0.2) == [start] and simgraph.find_path(edges, start, -1, 2, 0.2) is None
    deep = {r["id"] for r in simgraph.depth_first(edges, start, 2, 0.2).collect()}
    assert deep <= {r["id"] for r in simgraph.traverse(edges, start, 5, 0.2).collect()}
    assert simgraph.pruned(edges, 2.0).count() == 0
    assert simgraph.refine(edges, df, 0.2).count() >= edges.count()
    assert simgraph.mutual(edges, start, start, 0.2).count() == sum(a == start for a, _ in pairs)
    assert simgraph.relationships(edges, start, 2, 0.2, 0.9999).count() == 0


def test_vector_mathematics(spark, points):
    x, df = points
    assert np.allclose(vmath.centroid(df), x.mean(0), atol=1e-6)
    assert np.allclose(vmath.centroid(df, [1, 2, 999], [1, 3]), (x[0] + 3 * x[1]) / 4, atol=1e-6)
    with pytest.raises(ValueError):
        vmath.centroid(df, [1, 2], [1, -1])
    with pytest.raises(LookupError):
        vmath.centroid(df, [999])
    assert np.allclose(vmath.centroid_without(vmath.centroid_with([1, 1], 1, [3, 3]), 2, [3, 3]), [1, 1])
    assert vmath.centroid_without([1], 1, [1]) is None
    assert np.allclose(vmath.slerp([1, 0], [0, 1], 0.5), [math.sqrt(0.5)] * 2) and vmath.lerp([0], [2], 0.5) == [1]
    assert vmath.sequence([0.0], [1.0], 1) == [[0.0]] and vmath.sequence([0.0], [1.0], 0) == [] and len(vmath.sequence([1.0, 0], [0, 1.0], 5, "slerp")) == 5
    with pytest.raises(ValueError):
        vmath.lerp([0], [1], 2)
    p = vmath.pca(df, 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T.astype(float))))[::-1]
    assert np.allclose(p.explained_variance[0], values[0], rtol=0.05)
    assert p.transform(df).count() == 200
    c = vmath.kmeans(df, 4, seed=3)
    again = D.pairwise(np.array(c.centroids), x, "euclidean").argmin(0)
    assert {r["id"]: r["cluster"] for r in c.assignments.collect()} == {i + 1: int(k) for i, k in enumerate(again)}
    assert vmath.kmeans(df, 0).centroids == []
    assert vmath.cone(df, [0.0] * 8, 1.0).count() == 0 and vmath.in_cone([1, 0], [1, 0], 0.1)
    far = vmath.ghosts(df, 3.0, [[0.0] * 8])
    assert far.count() == int((np.linalg.norm(x, axis=1) > 3).sum())
    d = vmath.drift(df, df, threshold=0.1).first()
    assert d["centroid_shift"] == 0 and d["spread_change"] == 1 and not d["has_drifted"]
    assert vmath.analogy([1, 0], [0, 1], [1, 1]) == [2.0, 0.0]


def test_diversity_is_greedy(spark, points):
    x, df = points
    q = x[5].tolist()
    got = [r["id"] for r in vmath.diverse(df, q, 4, 0.6).orderBy("pos").collect()]
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    chosen = []
    for _ in range(4):
        best = max((i for i in range(200) if i not in chosen), key=lambda i: (0.6 * cos(x[i], x[5]) - 0.4 * max([cos(x[i], x[j]) for j in chosen], default=0), -i))
        chosen.append(best)
    assert got == [i + 1 for i in chosen]
    assert vmath.spread_out(df, 1).first()["id"] == 1 and vmath.spread_out(df, 5).count() == 5


def test_greedy_selections_take_any_number_of_candidates(spark, monkeypatch):
    """100,001 candidates, and the passes against the driver's greedy selection, with ties."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100_001, 3)).round(2)
    x[77], x[90_000] = [30.0, 30.0, 0.1], [-30.0, -30.0, -0.1]
    df = spark.createDataFrame(pa.table({"id": np.arange(100_001), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})).repartition(6)
    many = [r["id"] for r in vmath.diverse(df, [1.0, 0.0, 0.0], 3, 0.7).orderBy("pos").collect()]
    assert len(set(many)) == 3
    c = vmath._cosines(x.astype(np.float32).astype(float), np.array([1.0, 0.0, 0.0]))
    assert many[0] == int(c.argmax())
    small = df.filter("id % 61 = 0").union(df.filter("id % 610 = 0").selectExpr("id + 1000000 AS id", "embedding")).repartition(5)
    got = {}
    for few in (10_000, 0):
        monkeypatch.setattr(vmath, "FEW", few)
        monkeypatch.setattr(vmath, "STORED_EVERY", 4)
        monkeypatch.setattr(vmath, "BLOCK_ROWS", 100)
        got[few] = [
            [r["id"] for r in vmath.diverse(small, [1.0, 2.0, 0.0], 9, 0.4).orderBy("pos").collect()],
            [r["id"] for r in vmath.spread_out(small, 9).orderBy("pos").collect()],
            [r["id"] for r in vmath.spread_out(small, 1).collect()],
            [r["id"] for r in vmath.diverse(small.limit(3), [1.0, 2.0, 0.0], 9, 0.4).collect()].__len__(),
        ]
    assert got[0] == got[10_000]
    starts = vmath._starts(small, 12, "euclidean", 1)
    assert len(np.unique(starts, axis=0)) == 12 and len(vmath._starts(small.limit(5), 8, "euclidean", 1)) == 5


def test_codes(spark, points):
    x, df = points
    codes = quant.train_scalar(df)
    back = quant.scalar_decode(quant.scalar_encode(df, codes), codes).collect()
    width = x.max(0) - x.min(0)
    assert all(np.all(np.abs(np.array(r["embedding"]) - x[r["id"] - 1]) <= width / 255) for r in back)
    coded = quant.scalar_encode(df, codes)
    exact = [r["id"] for r in knn.search(df, x[3].tolist(), 5).orderBy("rank").collect()]
    assert [r["id"] for r in quant.scalar_search(df, coded, codes, x[3].tolist(), 5).orderBy("rank").collect()] == exact
    assert quant.scalar_search_among(df, coded, codes, x[3].tolist(), 5, df.filter("id <= 3").select("id")).count() == 3
    with pytest.raises(ValueError):
        quant.train_scalar(df.limit(0))
    words = quant.binary_encode(df)
    row = words.filter("id = 1").first()["code"]
    assert [row[0] >> b & 1 for b in range(8)] == [int(v >= 0) for v in x[0]]
    assert quant.binary_search(words, row, 1).first()["id"] == 1
    product = quant.train_product(df, 4, 16)
    assert quant.ProductCodes.decode(product, product.encode(df)).count() == 200
    hits = [r["id"] for r in product.search(product.encode(df), x[3].tolist(), 20).collect()]
    assert 4 in hits
    with pytest.raises(ValueError):
        quant.train_product(df, 3)
    cells = quant.train_cells(df, 8)
    celled = cells.add(df).persist()
    full = [r["id"] for r in cells.search(celled, x[3].tolist(), 5, 8).orderBy("rank").collect()]
    assert full == [r["id"] for r in knn.search(df, x[3].tolist(), 5, "euclidean").orderBy("rank").collect()]
    residual = cells.residuals(celled)
    rc = quant.train_product(residual, 4, 16)
    coded_rest = rc.encode(residual).join(celled.select("id", "cell"), "id")
    assert cells.residual_search(celled, coded_rest, rc, x[3].tolist(), 5, 3).count() == 5


def test_near_copies_keep_their_distance():
    rng = np.random.default_rng(1)
    x = rng.normal(size=1536)
    y = x.copy()
    y[7] += 1e-6
    assert math.isclose(D.pairwise(x[None], np.stack([y, -x]), "euclidean")[0, 0], 1e-6, rel_tol=1e-6)


def test_queries_beyond_the_driver_meet_block_by_block(spark, points, monkeypatch):
    x, df = points
    queries = df.select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
    want = sorted((r["qid"], r["rank"], r["id"]) for r in knn.batch_search(df, queries, 3).collect())
    monkeypatch.setattr(knn, "QUERY_BYTES", 1000)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 8 * 8 * 30)
    assert sorted((r["qid"], r["rank"], r["id"]) for r in knn.batch_search(df, queries, 3).collect()) == want
    assert knn.batch_search(df.limit(0), queries, 3).count() == 0


def test_a_mixed_batch_reads_equal_requests_once(spark, points):
    x, df = points
    requests = [knn.Request(df, x[0].tolist(), 2), knn.Request(df, x[1].tolist(), 4), knn.Request(df, x[2].tolist(), 3, "euclidean", field("label").eq(2)), knn.Request(df, x[3].tolist(), 1, strategy="post_filter", where=field("label").eq(1))]
    got = {(r["qid"], r["rank"]): r["id"] for r in knn.mixed_batch(requests).collect()}
    for n, r in enumerate(requests):
        one = knn.filtered_search(r.vectors, r.query, r.k, r.where, r.strategy, r.metric).collect()
        assert {k: v for (q, k), v in got.items() if q == n} == {row["rank"]: row["id"] for row in one}


def test_results_with_graph_edges_and_warning(spark, points):
    _, df = points
    edges = simgraph.build(df, 0.1)
    found = knn.search(df, [1.0] * 8, 3)
    rows = knn.with_graph(found, edges, threshold=0.2).collect()
    for r in rows:
        want = [(e["dst"], e["similarity"]) for e in edges.filter((F.col("src") == r["id"]) & (F.col("similarity") >= 0.2)).orderBy(F.desc("similarity"), "dst").limit(10).collect()]
        assert [(e["target"], e["similarity"]) for e in r["graph_edges"]] == want
    assert knn.warning("ready") is None and knn.warning("pending_optimization")


def test_ordered_numbers_over_many_partitions(spark):
    from quillon.lineage import in_order

    rows = [(int(v),) for v in np.random.default_rng(0).integers(0, 1000, 500)]
    got = in_order(spark.createDataFrame(rows, "x long").repartition(7), "n", "x").collect()
    assert sorted(r["n"] for r in got) == list(range(500)) and [r["x"] for r in sorted(got, key=lambda r: r["n"])] == sorted(v for (v,) in rows)


@pytest.mark.parametrize("metric", D.METRICS)
def test_equal_vectors_tie_in_every_block(spark, metric, monkeypatch):
    """3,000 vectors with copies, near copies, zeros and no numbers, met in blocks, some tasks reading one block only."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1500:1700] = x[40]
    x[2000:2400] = x[:400]
    x[2999] = x[7] + np.float32(1e-6)
    x[[3, 4, 2500]] = 0
    x[5, 2], x[6, 1] = np.nan, np.inf
    own = np.arange(1, 3001) * 7 % 3001
    df = spark.createDataFrame(pa.table({"id": own, "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})).repartition(5)
    queries = df.filter("id % 25 = 1 or id < 30").select(F.col("id").alias("qid"), F.col("embedding").alias("query"))
    want = {}
    for q in np.flatnonzero((own % 25 == 1) | (own < 30)):
        with np.errstate(all="ignore"):
            d = knn.exact(np.repeat(x[[q]], len(x), 0).astype(float), x.astype(float), metric)
        want[int(own[q])] = own[np.lexsort((own, np.where(np.isnan(d), 0, d), np.isnan(d)))[:6]].tolist()
    for most in (1, 32):
        monkeypatch.setattr(knn, "QUERY_BYTES", 1000)
        monkeypatch.setattr(knn, "BLOCK_BYTES", 24 * 4 * 500)
        monkeypatch.setattr(knn, "MOST_BLOCKS", most)
        got = {}
        for r in knn.batch_search(df, queries, 6, metric).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == want


def test_the_least_alike_pair_of_two_blocks():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8))
    x[300:330], x[600:640] = x[11], -x[11]  # many equal pairs
    x[[5, 650]] = 0
    x[17, 2] = np.nan
    o = np.arange(700)
    a, b = (o[:400], o[:400] * 2, x[:400]), (o[400:], o[400:] * 2, x[400:])
    want = min((float(vmath._cosines(x[[i]], x[[j]])[0]), i, 2 * i, j, 2 * j) for i in (11, *range(300, 330)) for j in range(600, 640))
    found = vmath._least_alike(a, b, False, None)
    assert found == want and vmath._least_alike(b, a, False, None) == want
    assert vmath._least_alike(a, a, True, found) == found and vmath._least_alike(a, a, True, None)[0] > want[0]
