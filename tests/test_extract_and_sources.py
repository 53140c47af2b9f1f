import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.text import alike, block_keys, content_hash, few_edits, name_of, normalized_name
from quillon.operators import extract
from quillon.operators.extract import EdgeType, EntityLabel, Ontology
from quillon.operators.graph import EDGES, NODES, Graph
from quillon.sources.collection import Catalog, config, np_insert, np_search, read_f32, read_npy
from quillon.streaming.ingest import ingest


class Words:
    """A stand-in for a language model: capitalised words are entities, neighbours know each other."""

    model, max_tokens = "gpt-4o", 100

    def extract(self, text, ontology, prompt_version):
        if "FAIL" in text:
            raise RuntimeError("no answer")
        names = [w for w in text.split() if w[:1].isupper()]
        return {"entities": [{"ref": n, "label": "Person", "name": n} for n in names], "edges": [{"source": a, "target": b, "edge_type": "KNOWS", "confidence": 0.5} for a, b in zip(names, names[1:], strict=False)], "input_tokens": 10, "output_tokens": 5}


ONTOLOGY = Ontology((EntityLabel("Person"),), (EdgeType("KNOWS"),))


def test_names(spark):
    assert name_of('  "Ａcme   Corp."  ') == "acme corp" and name_of("ACME Corp.,") == "acme corp" and name_of(None) is None
    assert alike("j. smith", "john smith") and not alike("j. s.", "john smith")
    assert alike("ibm", "international business machines") and alike("microsoft", "microsoftt") and not alike("cat", "car")
    assert alike("new york", "new york city") and not alike("york", "new york city") and not alike("", "")
    df = spark.createDataFrame([("abcdefghi", "abcdefgxx"), ("abcd", "abce"), ("abcdef", "abcdex")], "a string, b string")
    assert [r[0] for r in df.select(few_edits(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert spark.createDataFrame([(" A   b ",)], "t string").select(content_hash(F.col("t")) == F.sha2(F.lit("A b"), 256)).first()[0]
    assert spark.createDataFrame([("ﬁ X",)], "t string").select(normalized_name("t")).first()[0] == "fi x"


def test_ontologies():
    out = extract.merged(ONTOLOGY, Ontology((EntityLabel("Person", "new"),), (), "prompt", link_passages=True), [("entity_label", "Place", ""), ("edge_type", "KNOWS", "other")])
    assert out.label_names() == ["Person", "Place"] and out.labels[0].description == "new" and "mentions" in out.type_names() and out.system_prompt == "prompt"
    assert len(extract.TEMPLATES) == 5 and extract.prompt_digest(ONTOLOGY) is None and extract.prompt_digest(out)
    ids, made, aliases = extract.resolve_in_order([("P", "John Smith"), ("P", "J. Smith"), ("P", "Zed")], [(1, "P", "john smith")], 10)
    assert ids == [1, 1, 10] and made == [(10, "P", "Zed")] and aliases == {1: ["J. Smith"]}


@pytest.fixture
def empty(spark):
    return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), now_ms=5)


def test_extraction_and_diff(spark, empty):
    chunks = spark.createDataFrame([("d", 1, "Ann met Bob"), ("d", 2, "Bob met Cid"), ("d", 3, "FAIL")], "doc_id string, chunk_id long, text string")
    stored = spark.createDataFrame([], extract.CHUNK_HASHES)
    g, hashes, _, status = extract.run_job(empty, chunks, stored, Words(), ONTOLOGY)
    assert status.status == "completed_with_errors" and status.failed == 1 and status.input_tokens == 20
    assert sorted(json.loads(r["properties"])["name"] for r in g.nodes.collect()) == ["Ann", "Bob", "Cid"] and g.edges.count() == 2
    assert sorted(r["chunk_id"] for r in hashes.collect()) == [1, 2]
    diff = {r["chunk_id"]: r["status"] for r in extract.document_diff(chunks.filter("chunk_id <> 2"), hashes).collect()}
    assert diff == {1: "unchanged", 2: "deleted", 3: "new"}
    changed = spark.createDataFrame([("d", 1, "Ann met Bob"), ("d", 4, "Dan met Ann")], "doc_id string, chunk_id long, text string")
    g2, hashes2, counts, job = extract.re_extract(g, changed, hashes, Words(), ONTOLOGY)
    assert counts == {"new": 1, "changed": 0, "unchanged": 1, "deleted": 1} and job.status == "completed"
    assert g2.edges.filter("provenance.source_chunk_id = 2").count() == 0 and g2.edges.count() == 2
    found = extract.extracted(chunks, Words(), ONTOLOGY)
    assert extract.proposals(found, Ontology()).count() == 2
    cost = extract.cost_preview(chunks, "gpt-4o", 100).first()
    assert cost["chunks"] == 3 and cost["pricing_known"] and cost["input_tokens"] == 3 + 3 + 1 + 1200
    assert not extract.cost_preview(chunks, "other", 100).first()["pricing_known"]
    cache = spark.createDataFrame([], "cache_key string, entities array<struct<ref:string,label:string,name:string,properties:string>>, edges array<struct<source:string,target:string,edge_type:string,properties:string,confidence:float,source_text:string>>")
    _, fresh = extract.cached(chunks, cache, Words(), ONTOLOGY)
    hit, none = extract.cached(chunks, fresh, Words(), ONTOLOGY)
    assert fresh.count() == 2 and hit.agg(F.sum("input_tokens")).first()[0] == 0 and none.count() == 0
    _, all_hashes, manifest, total = extract.re_extract_corpus(empty, chunks.unionByName(changed.withColumn("doc_id", F.lit("e"))), stored, Words(), ONTOLOGY)
    assert {r["doc_id"]: r["status"] for r in manifest.collect()} == {"d": "failed", "e": "completed"} and total == "completed_with_errors"


def test_reject_rules_and_fuzzy(spark, empty):
    g = empty.put_node(1, "entity", "Person", '{"name": "Ann"}').put_node(2, "entity", "Person", '{"name": "John Smith"}')
    rules = spark.createDataFrame([(None, None, "KNOWS", "ANN", None)], "source_doc string, source_chunk_id long, edge_type string, source_name string, target_name string")
    g = Graph(g.nodes, g.edges, rules, 5)
    chunks = spark.createDataFrame([("d", 1, "Ann Bob Ann")], "doc_id string, chunk_id long, text string")
    out = extract.process_chunks(g, extract.extracted(chunks, Words(), ONTOLOGY), ONTOLOGY)
    assert out.edges.count() == 1 and out.edges.first()["target"] == 1
    names = spark.createDataFrame([("a", "Person", "J. Smith"), ("b", "Person", "Ann"), ("c", "Place", "Ann")], "name_id string, label string, name string")
    assert {r["name_id"]: r["id"] for r in extract.fuzzy_matches(names, g.nodes).collect()} == {"a": 2, "b": 1}
    assert {r["name_id"]: r["id"] for r in extract.exact_matches(names, g.nodes).collect()} == {"b": 1}


class Given:
    """Answers by chunk: the text is JSON."""

    model, max_tokens = "gpt-4o", 100

    def extract(self, text, ontology, prompt_version):
        return json.loads(text)


def test_new_names_that_are_alike_are_one_entity(spark, empty):
    ontology = Ontology((EntityLabel("Person"), EntityLabel("Org")), (EdgeType("WORKS_FOR"), EdgeType("SAID_IN")), resolution="fuzzy")
    one = {"entities": [{"ref": "a", "label": "Person", "name": "John Smith"}, {"ref": "b", "label": "Org", "name": "Acme Corp", "properties": {"size": 3}}, {"ref": "x", "label": "Planet", "name": "Mars"}], "edges": [{"source": "a", "target": "b", "edge_type": "WORKS_FOR"}]}
    two = {"entities": [{"ref": "a", "label": "Person", "name": "J. Smith"}, {"ref": "c", "label": "Org", "name": "Acme Corp Ltd"}], "edges": [{"source": "a", "target": "c", "edge_type": "WORKS_FOR"}, {"source": "a", "target": "@chunk", "edge_type": "SAID_IN"}, {"source": "gone", "target": "a", "edge_type": "WORKS_FOR"}]}
    chunks = spark.createDataFrame([("d", 71, json.dumps(one)), ("d", 72, json.dumps(two))], "doc_id string, chunk_id long, text string")
    found = extract.extracted(chunks, Given(), ontology)
    g = extract.process_chunks(empty, found, ontology, chunks=chunks)
    nodes = {r["id"]: (r["kind"], r["label"], json.loads(r["properties"])) for r in g.nodes.collect()}
    assert nodes == {
        1: ("entity", "Person", {"name": "John Smith", "name_norm": "john smith", "aliases": ["J. Smith"]}),
        2: ("entity", "Org", {"size": 3, "name": "Acme Corp", "name_norm": "acme corp", "aliases": ["Acme Corp Ltd"]}),
        72: ("content", None, {"text": json.dumps(two), "doc_id": "d"}),
    }
    assert sorted((r["source"], r["target"], r["edge_type"]) for r in g.edges.collect()) == [(1, 2, "WORKS_FOR"), (1, 2, "WORKS_FOR"), (1, 72, "SAID_IN")]
    # again: the same nodes, and the chunks' own edges are replaced
    again = extract.process_chunks(g, found, ontology, chunks=chunks)
    assert {r["id"]: json.loads(r["properties"]) for r in again.nodes.collect()} == {k: v[2] for k, v in nodes.items()} and again.edges.count() == 3
    strict = extract.process_chunks(empty, found, Ontology(ontology.labels, ontology.edge_types), chunks=chunks)
    assert strict.nodes.filter("kind = 'entity'").count() == 4


def test_fuzzy_resolution_is_that_of_one_name_after_the_other(spark, empty):
    rng = np.random.default_rng(4)
    words = ["john", "smith", "jon", "j.", "s.", "ibm", "international", "business", "machines", "acme", "corp", "corporation", "york"]
    names = [("P" if rng.random() < 0.7 else "Q", " ".join(rng.choice(words, rng.integers(1, 4)))) for _ in range(120)]
    known = [(3, "P", "john smith"), (5, "Q", "acme corporation")]
    ids, made, aliases = extract.resolve_in_order(names, known, 6)
    g = empty
    for i, label, name in known:
        g = g.put_node(i, "entity", label, json.dumps({"name": name}))
    entities = [{"ref": str(k), "label": label, "name": name} for k, (label, name) in enumerate(names)]
    ontology = Ontology((EntityLabel("P"), EntityLabel("Q")), (EdgeType("IS"),), resolution="fuzzy")
    answers = {k: {"entities": entities[k : k + 10], "edges": [{"source": e["ref"], "target": "@chunk", "edge_type": "IS", "source_text": e["ref"]} for e in entities[k : k + 10]]} for k in range(0, 120, 10)}
    chunks = spark.createDataFrame([("d", 1000 + k, json.dumps(a)) for k, a in answers.items()], "doc_id string, chunk_id long, text string")
    out = extract.process_chunks(g, extract.extracted(chunks, Given(), ontology), ontology, chunks=chunks)
    assert {int(r["provenance"]["source_text"]): r["source"] for r in out.edges.collect()} == dict(enumerate(ids))
    bags = {r["id"]: json.loads(r["properties"]) for r in out.nodes.filter("kind = 'entity'").collect()}
    assert {i: bags[i]["name"] for i, _, _ in made} == {i: name for i, _, name in made}
    assert {i: b["aliases"] for i, b in bags.items() if b.get("aliases")} == {i: list(dict.fromkeys(x)) for i, x in aliases.items()}


def test_block_keys_lose_no_alike_names():
    rng = np.random.default_rng(7)
    words = ["john", "smith", "jon", "j.", "international", "business", "machines", "ibm", "acme", "corp", "new", "york", "university"]
    names = set()
    for _ in range(300):
        name = list(" ".join(rng.choice(words, rng.integers(1, 5))))
        for _ in range(rng.integers(0, 3)):
            name[rng.integers(0, len(name))] = rng.choice(["", "x", "yz"])
        names.add(" ".join("".join(name).split()))
    names = sorted(names - {""})
    probes, keys = {n: set(block_keys(n, True)) for n in names}, {n: set(block_keys(n, False)) for n in names}
    assert all(probes[a] & keys[b] for a in names for b in names if alike(a, b))


def test_collection(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "cat"))
    c = catalog.create(config("things", 2, quantization="sq8", mode="auto_similarity", threshold=0.5))
    assert catalog.list() == ["things"] and catalog.get("things").config == c.config
    for bad in ("_x", "a b", ""):
        with pytest.raises(ValueError):
            config(bad, 2)
    with pytest.raises(ValueError):
        catalog.create(c.config)
    given = c.insert(spark.createDataFrame([(0, [1.0, 0.0], "a"), (7, [0.0, 1.0], "b"), (0, [0.5, 0.5], None)], "id long, embedding array<float>, name string"))
    assert sorted(r["id"] for r in given.collect()) == [7, 8, 9]
    for rows in ([(7, [1.0, 1.0], "x")], [(70, [1.0], "x")], [(71, [1.0, float("nan")], "x")]):
        with pytest.raises(Exception, match="exists|finite"):
            c.insert(spark.createDataFrame(rows, "id long, embedding array<float>, name string"))
    c.update(spark.createDataFrame([(7, "c")], "id long, name string"))
    row = c.get(7)
    assert row["name"] == "c" and row["version"] == 2 and list(row["embedding"]) == [0.0, 1.0]
    c.delete([8])
    assert c.get(8) is None and c.load().count() == 2
    with pytest.raises(KeyError):
        c.delete([8])
    assert c.optimize() == "completed" and c.optimize() == "already_optimized"
    done = c.compact(1)
    assert done["written"] == 2 and c.load().count() == 2 and c.compact() == {"merged": 0, "written": 0, "removed": 0}
    np_insert(c, np.array([[0.9, 0.1]], np.float32))
    assert np_search(c, np.array([0.9, 0.1]), 1)[0].tolist() == [10]
    c.backup(str(tmp_path / "copy"))
    other = catalog.create(config("other", 2))
    assert other.restore(str(tmp_path / "copy")) == 3 and other.load().count() == 3
    catalog.delete("things")
    assert catalog.list() == ["other"]


def test_files_and_stream(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "ids.npy", np.array([5, 6, 7, 8], "<i8"))
    x.tofile(tmp_path / "x.f32")
    rows = {r["id"]: list(r["embedding"]) for r in read_npy(spark, str(tmp_path / "x.npy"), str(tmp_path / "ids.npy"), chunk=3).collect()}
    assert rows == {5 + i: x[i].tolist() for i in range(4)}
    assert read_f32(spark, str(tmp_path / "x.f32"), 3).count() == 4
    with pytest.raises(ValueError):
        read_f32(spark, str(tmp_path / "x.f32"), 5)
    with pytest.raises(ValueError):
        read_npy(spark, "relative.npy")
    c = Catalog(spark, str(tmp_path / "cat")).create(config("s", 3))
    read_npy(spark, str(tmp_path / "x.npy")).unionByName(spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (9, [])], "id long, embedding array<float>")).write.parquet(str(tmp_path / "in"))
    errors = []
    for _ in range(2):
        stream = spark.readStream.schema("id long, embedding array<float>").parquet(str(tmp_path / "in"))
        ingest(stream, c, str(tmp_path / "check"), lambda bad, n: errors.extend(r["error"] for r in bad.collect())).awaitTermination()
    assert c.load().count() == 4 and len(errors) == 2


def test_bulk_insertion_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from quillon.sources import bulk

    c = Catalog(spark, str(tmp_path / "cat")).create(config("b", 2))
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 31)] + [(99, [1.0])], "id long, embedding array<float>")
    calls, original = [], type(c).insert

    def failing(self, part):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return original(self, part)

    monkeypatch.setattr(type(c), "insert", failing)
    monkeypatch.setattr(bulk.uuid, "uuid4", lambda: type("U", (), {"hex": "t"})())
    with pytest.raises(RuntimeError):
        bulk.bulk_insert(c, rows, bulk.BulkOptions(checkpoint_every=10))
    monkeypatch.setattr(type(c), "insert", original)
    monkeypatch.undo()
    assert 0 < c.load().count() < 30
    done = bulk.bulk_insert(c, rows, bulk.BulkOptions(checkpoint_every=10, resume_token="t"))
    assert done.inserted == 30 and c.load().count() == 30
    again = bulk.bulk_insert(c, rows, bulk.BulkOptions(checkpoint_every=10, resume_token="t"))
    assert again.inserted == 30 and c.load().count() == 30
    for bad in ({"index_mode": "x"}, {"checkpoint_every": -1}):
        with pytest.raises(ValueError):
            bulk.BulkOptions(**bad)
    with pytest.raises(KeyError):
        bulk.bulk_insert(c, rows, bulk.BulkOptions(resume_token="none"))


def test_thresholds_status_and_arrays(spark, tmp_path):
    from quillon.sources import arrays

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3)).astype(np.float32)
    c = Catalog(spark, str(tmp_path / "cat")).create(config("t", 3, mode="auto_similarity", threshold=0.5))
    arrays.np_insert(c, x)
    assert c.status()["status"] == "pending_optimization" and c.optimize() == "completed" and c.status()["status"] == "ready"
    c.set_threshold(0.9, 3).set_threshold(0.8, 3)
    assert [tuple(r) for r in c.thresholds().collect()] == [(3, 0.8)]
    with pytest.raises(KeyError):
        c.set_threshold(0.9, 300)
    c = c.set_threshold(0.6)
    assert c.status()["status"] == "pending_optimization" and c.config.threshold == 0.6
    assert np.allclose(arrays.np_get(c, 1)[0], x[0]) and arrays.np_get(c, 999) is None
    assert np.allclose(arrays.np_centroid(c), x.mean(0), atol=1e-6) and np.allclose(arrays.np_interpolate(x[0], x[1]), (x[0] + x[1]) / 2, atol=1e-6)
    assert arrays.np_cluster(c, 3).centroids.shape == (3, 3)
    found = arrays.np_pca(c, 2)
    assert found.components.shape == (2, 3) and found.projected.count() == 40


def test_jobs_take_turns(spark, empty):
    from quillon.operators.jobs import Jobs

    frame = lambda *rows: spark.createDataFrame(rows, "doc_id string, chunk_id long, text string")
    jobs = Jobs(empty, Words(), ONTOLOGY, spark.createDataFrame([], extract.CHUNK_HASHES))
    one, two, three = jobs.submit(frame(("a", 1, "Ann met Bob"), ("b", 2, "FAIL"))), jobs.submit(frame(("c", 3, "Cid met Dan"))), jobs.submit(frame(("d", 4, "Eve met Fay"), ("e", 5, "Gus")))
    assert jobs.step() and jobs.step()
    assert [jobs.status(j)["status"] for j in (one, two, three)] == ["running", "completed", "queued"]
    jobs.append(one, frame(("f", 6, "Ann met Cid")))
    jobs.cancel(three)
    with pytest.raises(ValueError):
        jobs.append(three, frame(("g", 7, "Hal")))
    jobs.run()
    assert jobs.status(one)["status"] == "completed_with_errors" and jobs.status(one)["total"] == 3 and jobs.status(three) | {"errors": []} == {"status": "cancelled", "waiting": 0, "skipped": 2, "total": 0, "done": 0, "failed": 0, "input_tokens": 0, "output_tokens": 0, "errors": []}
    assert sorted(json.loads(r["properties"])["name"] for r in jobs.graph.nodes.collect()) == ["Ann", "Bob", "Cid", "Dan"]


def test_plans_run_beside_the_caller(spark, empty):
    import asyncio

    from quillon.plans.hybrid import NodeQuery

    query = NodeQuery(empty, spark.createDataFrame([], "id long, embedding array<float>")).from_nodes([4, 2])
    assert [r["id"] for r in asyncio.run(query.arun()).orderBy("pos").collect()] == [4, 2]
