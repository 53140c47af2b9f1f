"""Graphs from text: ontologies, an adapter to a language model, entity resolution, chunk processing, diffs, costs and jobs."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import alike, collapsed, content_hash, keys_of, name_of, names_alike, normalized_name, probes_of
from quillon.lineage import cut, in_order
from quillon.operators.graph import EDGES, NODES, Graph, shaped

CHUNKS = "doc_id string, chunk_id long, text string, embedding array<float>"
CHUNK_HASHES = "doc_id string, chunk_id long, hash string"
PROPOSALS = "id string, kind string, name string, description string, examples array<string>, status string, source_doc string, source_chunk_id long"
#: What an adapter gives for a chunk.
FOUND = (
    "doc_id string, chunk_id long, entities array<struct<ref:string,label:string,name:string,properties:string>>, "
    "edges array<struct<source:string,target:string,edge_type:string,properties:string,confidence:float,source_text:string>>, input_tokens long, output_tokens long, error string"
)
MENTIONS = "mentions"
#: What an edge calls the passage that it comes from.
CHUNK = "@chunk"
#: Likeness of embeddings at which one could merge entities; resolution goes by names only.
EMBEDDING_LIKENESS = 0.92
ERRORS_KEPT = 100


# --- ontologies ---


@dataclass(frozen=True)
class EdgeType:
    name: str
    description: str = ""
    source_labels: tuple[str, ...] = ()
    target_labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class EntityLabel:
    name: str
    description: str = ""


@dataclass(frozen=True)
class Ontology:
    labels: tuple[EntityLabel, ...] = ()
    edge_types: tuple[EdgeType, ...] = ()
    system_prompt: str | None = None
    guidance: str | None = None
    link_passages: bool = False
    resolution: str = "exact"  # or fuzzy

    def label_names(self) -> list[str]:
        return [x.name for x in self.labels]

    def type_names(self) -> list[str]:
        return [x.name for x in self.edge_types]


def merged(base: Ontology, extension: Ontology, approved: Sequence[tuple[str, str, str]] = ()) -> Ontology:
    """base and extension, whose entries win by name and whose prompts hold, plus approved (kind, name, description) that are new;
    linking passages adds the edge type mentions unless it is there in any case of letters."""

    def over(a, b):
        own = {x.name: x for x in a}
        own.update({x.name: x for x in b})
        return own

    labels, types = over(base.labels, extension.labels), over(base.edge_types, extension.edge_types)
    for kind, name, description in approved:
        if kind == "entity_label":
            labels.setdefault(name, EntityLabel(name, description))
        else:
            types.setdefault(name, EdgeType(name, description))
    if extension.link_passages and MENTIONS not in {t.lower() for t in types}:
        types[MENTIONS] = EdgeType(MENTIONS, "a passage names an entity")
    return replace(extension, labels=tuple(labels.values()), edge_types=tuple(types.values()))


def _ontology(labels: dict[str, str], types: dict[str, tuple[str, str, str]]) -> Ontology:
    return Ontology(tuple(EntityLabel(x, d) for x, d in labels.items()), tuple(EdgeType(t, d, tuple(a.split()), tuple(b.split())) for t, (d, a, b) in types.items()))


# The five templates by name, with their labels, edge types and the labels that these may join.
TEMPLATES = {
    "research-papers": _ontology(
        {"Paper": "A research paper or article", "Author": "A person who authored a paper", "Institution": "A university, lab, or organization", "Date": "A calendar date such as a publication date", "Method": "A method, technique, or algorithm"},
        {
            "AUTHORED_BY": ("Links a paper to one of its authors", "Paper", "Author"),
            "AFFILIATED_WITH": ("Links an author to an institution", "Author", "Institution"),
            "CITES": ("Links a paper to another paper it cites", "Paper", "Paper"),
            "USES_METHOD": ("Links a paper to a method it uses", "Paper", "Method"),
            "FUNDED_BY": ("Links a paper to a funding institution", "Paper", "Institution"),
        },
    ),
    "legal-contracts": _ontology(
        {"Party": "A signatory or party to an agreement", "Document": "A contract, agreement, or legal document", "Jurisdiction": "A governing jurisdiction or venue", "Date": "A calendar date such as an effective date", "Provision": "A clause, term, or provision"},
        {
            "PARTY_TO": ("Links a party to a document it is a party to", "Party", "Document"),
            "GOVERNED_BY": ("Links a document to its governing jurisdiction", "Document", "Jurisdiction"),
            "REFERENCES": ("Links a document to another document it references", "Document", "Document"),
            "AMENDS": ("Links a document to a document it amends", "Document", "Document"),
            "EFFECTIVE_FROM": ("Links a document to its effective date", "Document", "Date"),
        },
    ),
    "ecommerce-catalog": _ontology(
        {"Product": "A purchasable product", "Brand": "A product brand or manufacturer", "Category": "A product category", "Customer": "A person who buys products"},
        {
            "MADE_BY": ("Links a product to the brand that makes it", "Product", "Brand"),
            "BELONGS_TO": ("Links a product to a category it belongs to", "Product", "Category"),
            "BOUGHT": ("Links a customer to a product they bought", "Customer", "Product"),
        },
    ),
    "support-tickets": _ontology(
        {"Ticket": "A support ticket or case", "Customer": "A customer who raised a ticket", "Product": "A product a ticket is about", "Issue": "A problem or issue category", "Agent": "A support agent who handled a ticket"},
        {
            "REPORTED_BY": ("Links a ticket to the customer who reported it", "Ticket", "Customer"),
            "ABOUT_PRODUCT": ("Links a ticket to the product it is about", "Ticket", "Product"),
            "HAS_ISSUE": ("Links a ticket to the issue it concerns", "Ticket", "Issue"),
            "HANDLED_BY": ("Links a ticket to the agent who handled it", "Ticket", "Agent"),
        },
    ),
    "internal-docs": _ontology(
        {"Document": "An internal document or note", "Person": "A person mentioned or involved", "Project": "A project or initiative", "Decision": "A decision recorded in a document"},
        {
            "AUTHORED_BY": ("Links a document to its author", "Document", "Person"),
            "MENTIONS": ("Links a document to a person or project it mentions", "Document", ""),
            "DECIDED_ON": ("Links a document to a decision it records", "Document", "Decision"),
            "REFERENCES": ("Links a document to another document it references", "Document", "Document"),
        },
    ),
}


def proposal_id(kind: str, name: str, source: str) -> str:
    return hashlib.sha256(f"{kind}\0{name}\0{source}".encode()).hexdigest()


def proposals(found: DataFrame, ontology: Ontology) -> DataFrame:
    """A pending proposal for each label and edge type that the ontology lacks."""
    labels = found.select("doc_id", "chunk_id", F.explode("entities").alias("e")).select(F.lit("entity_label").alias("kind"), F.col("e.label").alias("name"), "doc_id", "chunk_id", F.col("e.name").alias("example"))
    types = found.select("doc_id", "chunk_id", F.explode("edges").alias("e")).select(F.lit("edge_type").alias("kind"), F.col("e.edge_type").alias("name"), "doc_id", "chunk_id", F.col("e.source_text").alias("example"))
    new = labels.filter(~F.col("name").isin(ontology.label_names())).unionByName(types.filter(~F.col("name").isin(ontology.type_names())))
    rows = new.groupBy("kind", "name", "doc_id").agg(F.min("chunk_id").alias("source_chunk_id"), F.slice(F.array_sort(F.collect_set("example")), 1, 3).alias("examples"))
    ident = F.sha2(F.concat_ws("\0", "kind", "name", "doc_id"), 256)
    return shaped(rows.select(ident.alias("id"), "kind", "name", "examples", F.lit("pending").alias("status"), F.col("doc_id").alias("source_doc"), "source_chunk_id"), PROPOSALS)


def judged(rows: DataFrame, ids: Sequence[str], status: str) -> DataFrame:
    """proposals with some approved or rejected."""
    if status not in ("approved", "rejected"):
        raise ValueError(status)
    return rows.withColumn("status", F.when(F.col("id").isin(list(ids)), F.lit(status)).otherwise(F.col("status")))


# --- adapters, cache and costs ---


class Adapter(Protocol):
    """What reads one chunk; model and max_tokens say what it costs."""

    model: str
    max_tokens: int

    def extract(self, text: str, ontology: Ontology, prompt_version: str) -> dict: ...


class HttpAdapter:
    """A chat-completions service over HTTP; three tries with growing waits from 0.5 to 8 seconds."""

    def __init__(self, url: str, key: str, model: str, max_tokens: int = 2048, tries: int = 3):
        self.url, self.key, self.model, self.max_tokens, self.tries = url, key, model, max_tokens, tries

    def extract(self, text: str, ontology: Ontology, prompt_version: str) -> dict:
        prompt = ontology.system_prompt or "Extract entities and relations as JSON with the lists entities and edges."
        told = f"{prompt}\n{ontology.guidance or ''}\nLabels: {', '.join(ontology.label_names())}\nRelations: {', '.join(ontology.type_names())}\nVersion: {prompt_version}"
        body = json.dumps({"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": "system", "content": told}, {"role": "user", "content": text}]}).encode()
        for n in range(self.tries):
            try:
                request = urllib.request.Request(self.url, body, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=120) as answer:
                    got = json.load(answer)
                found = json.loads(got["choices"][0]["message"]["content"])
                used = got.get("usage", {})
                return found | {"input_tokens": used.get("prompt_tokens", 0), "output_tokens": used.get("completion_tokens", 0)}
            except (urllib.error.URLError, TimeoutError):
                if n + 1 == self.tries:
                    raise
                time.sleep(min(8.0, 0.5 * 2**n))
        raise RuntimeError("no try was made")


def extracted(chunks: DataFrame, adapter: Adapter, ontology: Ontology, prompt_version: str = "1") -> DataFrame:
    """FOUND rows; a chunk that fails has its error and doesn't stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, chunk, text in zip(pdf["doc_id"], pdf["chunk_id"], pdf["text"], strict=True):
                try:
                    got = adapter.extract(text or "", ontology, prompt_version)
                    entities = [{"ref": str(e.get("ref", e.get("name"))), "label": e.get("label"), "name": e.get("name"), "properties": json.dumps(e.get("properties", {}))} for e in got.get("entities", [])]
                    edges = [{"source": str(e.get("source")), "target": str(e.get("target")), "edge_type": e.get("edge_type"), "properties": json.dumps(e.get("properties", {})), "confidence": float(e.get("confidence", 1.0)), "source_text": e.get("source_text")} for e in got.get("edges", [])]
                    rows.append((doc, chunk, entities, edges, int(got.get("input_tokens", 0)), int(got.get("output_tokens", 0)), None))
                except Exception as problem:
                    rows.append((doc, chunk, [], [], 0, 0, str(problem)))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "entities", "edges", "input_tokens", "output_tokens", "error"])

    return chunks.select("doc_id", "chunk_id", "text").mapInPandas(run, FOUND)


def prompt_digest(ontology: Ontology) -> str | None:
    """None if every prompt field is at its default."""
    if ontology.system_prompt is None and ontology.guidance is None and not ontology.link_passages:
        return None
    return hashlib.sha256(f"{ontology.system_prompt or ''}\x1f{ontology.guidance or ''}{chr(31) + 'lp1' if ontology.link_passages else ''}".encode()).hexdigest()


def cache_keys(chunks: DataFrame, model: str, prompt_version: str, ontology: Ontology) -> DataFrame:
    """chunks with cache_key, by which results are shared across collections."""
    digest = prompt_digest(ontology)
    parts = [collapsed(F.col("text")), F.lit(model), F.lit(prompt_version)] + ([F.lit(digest)] if digest else [])
    return chunks.withColumn("cache_key", F.sha2(F.concat_ws("\0", *parts), 256))


def cached(chunks: DataFrame, cache: DataFrame, adapter: Adapter, ontology: Ontology, prompt_version: str = "1") -> tuple[DataFrame, DataFrame]:
    """(found, fresh cache rows): what cache(cache_key, entities, edges) holds costs no tokens and no call."""
    keyed = cache_keys(chunks, adapter.model, prompt_version, ontology)
    hits = keyed.join(cache, "cache_key").select("doc_id", "chunk_id", "entities", "edges", F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(None).cast("string").alias("error"))
    missed = keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = extracted(missed, adapter, ontology, prompt_version)
    rows = fresh.filter("error is null").join(missed.select("doc_id", "chunk_id", "cache_key"), ["doc_id", "chunk_id"]).dropDuplicates(["cache_key"]).select("cache_key", "entities", "edges")
    return hits.unionByName(fresh), rows


# Fixed prices in dollars per million tokens: input, output.
PRICES = {"gpt-4o-mini": (0.15, 0.6), "gpt-4o": (2.5, 10.0), "gpt-4-turbo": (10.0, 30.0), "gpt-3.5-turbo": (0.5, 1.5)}
CHARS_PER_TOKEN, PROMPT_TOKENS, OUTPUT_SHARE = 4, 400, 0.4


def cost_preview(chunks: DataFrame, model: str, max_tokens: int, cached_keys: DataFrame | None = None) -> DataFrame:
    """One row: chunks (all), missed, input_tokens, output_tokens, dollars, pricing_known. Only chunks that aren't cached cost."""
    keyed = chunks if cached_keys is None else chunks.join(cached_keys.select("cache_key").distinct().withColumn("hit", F.lit(True)), "cache_key", "left")
    miss = F.lit(True) if cached_keys is None else F.col("hit").isNull()
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / CHARS_PER_TOKEN) + PROMPT_TOKENS
    row = keyed.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(miss.cast("long")), F.lit(0)).alias("missed"), F.coalesce(F.sum(F.when(miss, tokens)), F.lit(0)).alias("input_tokens"))
    row = row.withColumn("output_tokens", F.least(F.ceil(F.col("input_tokens") * OUTPUT_SHARE), F.col("missed") * max_tokens))
    a, b = PRICES.get(model, (0.0, 0.0))
    return row.withColumn("dollars", (F.col("input_tokens") * a + F.col("output_tokens") * b) / 1e6).withColumn("pricing_known", F.lit(model in PRICES))


# --- entity resolution ---


def named(nodes: DataFrame) -> DataFrame:
    """(id, label, norm) of entity nodes, by property name_norm or else name; blank names never match."""
    own = F.coalesce(F.get_json_object("properties", "$.name_norm"), normalized_name(F.get_json_object("properties", "$.name")))
    return nodes.filter("kind = 'entity'").select("id", "label", own.alias("norm")).filter("norm is not null and norm <> ''")


def exact_matches(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names(name_id, label, name) with the smallest id of the same label and normalised name."""
    left = names.withColumn("norm", normalized_name("name"))
    return left.join(named(nodes), ["label", "norm"]).groupBy("name_id").agg(F.min("id").alias("id"))


def alike_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r) of left(l, label, norm) and right(r, label, norm) of one label whose names are alike, told from few candidates by block keys."""
    one = left.select("l", "label", F.col("norm").alias("x"), F.explode(probes_of("norm")).alias("key"))
    two = right.select("r", "label", F.col("norm").alias("y"), F.explode(keys_of("norm")).alias("key"))
    met = one.join(two, ["label", "key"]).select("l", "r", "x", "y").distinct()
    return met.filter(names_alike("x", "y")).select("l", "r")


def fuzzy_matches(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same, and where no name is equal the smallest id of the label whose name is alike."""
    exact = exact_matches(names, nodes)
    rest = names.join(exact, "name_id", "left_anti").withColumn("norm", normalized_name("name")).filter("norm <> ''")
    pairs = alike_pairs(rest.select(F.col("name_id").alias("l"), "label", "norm"), named(nodes).select(F.col("id").alias("r"), "label", "norm"))
    return exact.unionByName(pairs.groupBy(F.col("l").alias("name_id")).agg(F.min("r").alias("id")))


def first_of_alike(names: DataFrame) -> DataFrame:
    """(name_id, first) for names(name_id, label, norm, at): each name takes the first one before it that stands for itself and is alike;
    where there is none it stands for itself.

    This is what taking the names one after the other by ``at`` gives. A name is settled once all alike names before it are, so the rounds
    are as many as the longest chain of alike names.
    """
    slim = cut(names.filter("norm <> ''").select("name_id", "label", "norm", "at"))
    pairs = alike_pairs(slim.select(F.struct("at", "name_id").alias("l"), "label", "norm"), slim.select(F.struct("at", "name_id").alias("r"), "label", "norm"))
    # each pair is found from at least one side
    both = F.array(F.struct(F.greatest("l", "r").alias("late"), F.least("l", "r").alias("early")))
    before = cut(pairs.filter("l <> r").select(F.explode(both).alias("p")).select(F.col("p.late.name_id").alias("name_id"), F.col("p.early.name_id").alias("other"), F.col("p.early.at").alias("at")).distinct())
    every = names.select("name_id")
    settled = cut(every.join(before.select("name_id").distinct(), "name_id", "left_anti").select("name_id", F.col("name_id").alias("first")))
    while True:
        known = before.join(settled.withColumnsRenamed({"name_id": "other", "first": "of"}), "other", "left").join(settled.select("name_id"), "name_id", "left_anti")
        ready = known.groupBy("name_id").agg(F.min(F.col("of").isNotNull()).alias("ok"), F.min(F.when(F.col("of") == F.col("other"), F.struct("at", "other"))).alias("lead")).filter("ok")
        fresh = cut(ready.select("name_id", F.coalesce("lead.other", "name_id").alias("first")))
        if fresh.isEmpty():
            return settled
        settled = cut(settled.unionByName(fresh))


def resolve_in_order(names: Sequence[tuple[str, str]], known: Sequence[tuple[int, str, str]], next_id: int, fuzzy: bool = True) -> tuple[list[int], list[tuple[int, str, str]], dict[int, list[str]]]:
    """Resolves (label, name) one after the other, as a new entity may match the next name: (ids, entities made, aliases).

    This order can't be spread over tasks; it takes the names of one chunk, and known holds the candidates of their labels.
    """
    table = sorted((i, label, name_of(name) or "") for i, label, name in known)
    ids, made, aliases = [], [], {}
    for label, name in names:
        norm = name_of(name) or ""
        hit = next((i for i, other, n in table if other == label and n and n == norm), None) if norm else None
        if hit is None and fuzzy and norm:
            hit = next((i for i, other, n in table if other == label and n and alike(norm, n)), None)
            if hit is not None:
                aliases.setdefault(hit, []).append(name)
        if hit is None:
            hit = next_id
            next_id += 1
            table.append((hit, label, norm))
            made.append((hit, label, name))
        ids.append(hit)
    return ids, made, aliases


def rejected(edges: DataFrame, rules: DataFrame, passed: bool = False) -> DataFrame:
    """edges(source_doc, source_chunk_id, edge_type, source_name, target_name, ...) that match a rule: the type exactly, document and
    chunk if the rule has them, names if it has them, in any case of ASCII letters. With passed, the edges that match none."""
    e, r = edges.alias("e"), rules.alias("r")
    fit = F.col("e.edge_type") == F.col("r.edge_type")
    for c in ("source_doc", "source_chunk_id"):
        fit = fit & (F.col(f"r.{c}").isNull() | (F.col(f"e.{c}") == F.col(f"r.{c}")))
    for c in ("source_name", "target_name"):
        fit = fit & (F.col(f"r.{c}").isNull() | (F.lower(f"e.{c}") == F.lower(f"r.{c}")))
    return e.join(r, fit, "left_anti" if passed else "left_semi")


@F.pandas_udf(T.StringType())
def _named_properties(properties: pd.Series, name: pd.Series, norm: pd.Series) -> pd.Series:
    """An entity's JSON properties with its name and normalised name."""
    return pd.Series([json.dumps((json.loads(p) if p else {}) | {"name": n, "name_norm": m}, ensure_ascii=False) for p, n, m in zip(properties, name, norm, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _with_aliases(properties: pd.Series, more: pd.Series) -> pd.Series:
    """JSON properties with the surface forms that aren't the name or an alias yet."""
    out = []
    for text, names in zip(properties, more, strict=True):
        bag = json.loads(text) if text else {}
        own = [x for x in bag["aliases"]] if isinstance(bag.get("aliases"), list) else []
        for name in names:
            if name != bag.get("name") and name not in own:
                own.append(name)
        out.append(json.dumps(bag | {"aliases": own} if own else bag, ensure_ascii=False))
    return pd.Series(out, dtype=object)


def process_chunks(graph: Graph, found: DataFrame, ontology: Ontology, vectors: DataFrame | None = None, chunks: DataFrame | None = None) -> Graph:
    """Writes adapters' results.

    Edges made from these chunks before go (manual and verified ones stay). Entities of known labels are resolved or made, in order of
    document, chunk and place; with fuzzy resolution a name that is alike but not equal becomes an alias of the node that it is resolved to,
    also where that node is made by the same call. A blank name makes a node of its own. A chunk with an edge to or from "@chunk" has a
    content node of its chunk id, which is made unless it is there; its text comes from chunks(doc_id, chunk_id, text). Edges of known types
    between resolved refs are added unless a rule rejects them or a manual or verified edge of the same ends and type is there.
    """
    good = found.filter("error is null")
    made_by = (F.col("provenance.source_doc") == F.col("d")) & (F.col("provenance.source_chunk_id") == F.col("c"))
    auto = ~F.coalesce("is_manual", F.lit(False)) & ~F.coalesce("verified", F.lit(False))
    done = good.select(F.col("doc_id").alias("d"), F.col("chunk_id").alias("c")).distinct()
    edges = graph.edges.join(graph.edges.filter(auto).join(done, made_by, "left_semi").select("id"), "id", "left_anti")

    entities = good.select("doc_id", "chunk_id", F.posexplode("entities").alias("place", "e")).filter(F.col("e.label").isin(ontology.label_names()))
    entities = entities.select(F.struct("doc_id", "chunk_id", "place").alias("at"), "e.ref", "e.label", F.coalesce("e.name", F.lit("")).alias("name"), "e.properties").withColumn("norm", normalized_name("name"))
    entities = entities.withColumn("name_id", F.when(F.col("norm") == "", F.to_json("at")).otherwise(F.concat_ws("\0", "label", "norm")))
    entities = cut(entities)
    names = cut(entities.groupBy("name_id", "label", "norm").agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name"), F.min_by("properties", "at").alias("properties")))
    asked, fuzzy = names.filter("norm <> ''").select("name_id", "label", "name"), ontology.resolution == "fuzzy"
    hits = cut((fuzzy_matches if fuzzy else exact_matches)(asked, graph.nodes))
    new = cut(names.join(hits, "name_id", "left_anti"))
    first = first_of_alike(new) if fuzzy else new.select("name_id", F.col("name_id").alias("first"))
    base = graph.next_id(vectors)
    made = in_order(new.join(first.filter("first = name_id").select("name_id"), "name_id", "left_semi"), "id", "at").withColumn("id", F.col("id") + base)
    resolved = cut(hits.select("name_id", "id").unionByName(first.join(made.select(F.col("name_id").alias("first"), "id"), "first").select("name_id", "id")))

    history = lambda action: F.array(F.struct(F.lit(action).alias("action"), F.lit(None).cast("string").alias("actor"), F.lit(graph.now_ms).cast("long").alias("at")))
    node_rows = made.select("id", F.lit("entity").alias("kind"), "label", _named_properties("properties", "name", "norm").alias("properties"), F.lit("extracted").alias("source"), F.lit(graph.now_ms).alias("created_at"), history("created").alias("history"))
    nodes = graph.nodes.unionByName(shaped(node_rows, NODES))
    if fuzzy:
        other = resolved.join(exact_matches(asked, graph.nodes).select("name_id"), "name_id", "left_anti").join(made.select("name_id"), "name_id", "left_anti")
        forms = entities.join(other, "name_id").groupBy("id", "name").agg(F.min("at").alias("at")).groupBy("id")
        forms = forms.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("__more"))
        nodes = nodes.join(forms, "id", "left").withColumn("properties", F.when(F.col("__more").isNull(), F.col("properties")).otherwise(_with_aliases("properties", F.coalesce("__more", F.array().cast("array<string>"))))).drop("__more")

    links = good.select("doc_id", "chunk_id", F.posexplode("edges").alias("place", "e")).select("doc_id", "chunk_id", "place", "e.*")
    at_chunk = links.filter((F.col("source") == CHUNK) | (F.col("target") == CHUNK)).select("doc_id", "chunk_id").distinct()
    text = F.lit(None).cast("string").alias("text")
    content = at_chunk.select("*", text) if chunks is None else at_chunk.join(chunks.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"], "left")
    content = content.groupBy(F.col("chunk_id").alias("id")).agg(F.min_by(F.struct("text", "doc_id"), F.col("doc_id")).alias("p")).join(graph.nodes.select("id"), "id", "left_anti")
    nodes = nodes.unionByName(shaped(content.select("id", F.lit("content").alias("kind"), F.to_json("p").alias("properties"), F.lit("extracted").alias("source"), F.lit(graph.now_ms).alias("created_at"), history("created").alias("history")), NODES))

    refs = entities.join(resolved, "name_id").groupBy("at.doc_id", "at.chunk_id", "ref").agg(F.max_by(F.struct("id", "name"), "at").alias("r"))  # the last of equal refs
    refs = refs.select("doc_id", "chunk_id", "ref", F.col("r.id").alias("node"), F.col("r.name").alias("name"))
    refs = refs.unionByName(at_chunk.select("doc_id", "chunk_id", F.lit(CHUNK).alias("ref"), F.col("chunk_id").alias("node"), F.lit(None).cast("string").alias("name")))
    ends = links.filter(F.col("edge_type").isin(ontology.type_names()))
    for side, short in (("source", "s"), ("target", "t")):
        of = refs.select("doc_id", "chunk_id", F.col("ref").alias(side), F.col("node").alias(short), F.col("name").alias(f"{side}_name"))
        ends = ends.join(of, ["doc_id", "chunk_id", side])
    ends = rejected(ends.withColumnsRenamed({"doc_id": "source_doc", "chunk_id": "source_chunk_id"}), graph.rejects, passed=True)
    kept = graph.edges.filter(F.col("is_manual") | F.col("verified")).select(F.col("source").alias("s"), F.col("target").alias("t"), "edge_type")
    ends = ends.join(kept, ["s", "t", "edge_type"], "left_anti")
    first_edge = base + made.count()
    provenance = F.struct("source_doc", "source_chunk_id", "source_text", *[F.lit(None).cast(t).alias(c) for c, t in (("model", "string"), ("prompt_version", "string"), ("extracted_at", "long"), ("cache_hit_at", "long"))])
    edge_rows = in_order(ends, "nth", "source_doc", "source_chunk_id", "place").select(
        (F.col("nth") + first_edge).alias("id"), F.col("s").alias("source"), F.col("t").alias("target"), "edge_type", "properties", provenance.alias("provenance"),
        F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(F.lit(1.0)).alias("confidence"), F.lit(False).alias("verified"), F.lit(False).alias("is_manual"), F.lit(graph.now_ms).alias("created_at"), history("extracted").alias("history"),
    )
    # later jobs start from these tables, not from the extraction
    return Graph(cut(shaped(nodes, NODES)), cut(edges.unionByName(shaped(edge_rows, EDGES))), graph.rejects, graph.now_ms)


# --- documents over time ---


def chunk_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_id", content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


def document_diff(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, status): new, unchanged or changed by hash; deleted where only stored has the chunk."""
    both = chunk_hashes(chunks).join(stored.select("doc_id", "chunk_id", F.col("hash").alias("old")), ["doc_id", "chunk_id"], "full")
    status = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "deleted").when(F.col("hash") == F.col("old"), "unchanged").otherwise("changed")
    return both.select("doc_id", "chunk_id", status.alias("status"))


@dataclass
class JobStatus:
    status: str
    total: int
    done: int
    failed: int
    input_tokens: int
    output_tokens: int
    errors: list[str]


def job_status(found: DataFrame) -> JobStatus:
    """completed without failures, failed without successes, else completed_with_errors; at most 100 errors are kept."""
    row = found.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("i"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("o")).first()
    errors = [r["error"] for r in found.filter("error is not null").select("error").limit(ERRORS_KEPT).collect()]
    status = "completed" if not row["bad"] else "failed" if row["bad"] == row["n"] else "completed_with_errors"
    return JobStatus(status, row["n"], row["n"] - row["bad"], row["bad"], row["i"], row["o"], errors)


def run_job(graph: Graph, chunks: DataFrame, stored: DataFrame, adapter: Adapter, ontology: Ontology, cache: DataFrame | None = None, prompt_version: str = "1") -> tuple[Graph, DataFrame, DataFrame | None, JobStatus]:
    """(graph, chunk hashes, cache, status) after chunks; a chunk's hash is stored only if it succeeded."""
    fresh = None
    if cache is None:
        found = extracted(chunks, adapter, ontology, prompt_version)
    else:
        found, fresh = cached(chunks, cache, adapter, ontology, prompt_version)
    found = cut(found)
    made = process_chunks(graph, found, ontology, chunks=chunks)
    good = found.filter("error is null").select("doc_id", "chunk_id")
    hashes = stored.join(good, ["doc_id", "chunk_id"], "left_anti").unionByName(chunk_hashes(chunks).join(good, ["doc_id", "chunk_id"], "left_semi"))
    hashes = cut(hashes)
    return made, hashes, cache.unionByName(fresh) if fresh is not None else None, job_status(found)


def without_chunks(graph: Graph, gone: DataFrame) -> Graph:
    """graph without the automatic edges of gone(doc_id, chunk_id), and without content nodes that they leave alone."""
    ours = F.struct(F.col("provenance.source_doc").alias("d"), F.col("provenance.source_chunk_id").alias("c"))
    keys = gone.select(F.struct(F.col("doc_id").alias("d"), F.col("chunk_id").alias("c")).alias("k")).distinct()
    auto = ~F.coalesce("is_manual", F.lit(False)) & ~F.coalesce("verified", F.lit(False))
    hit = graph.edges.filter(auto).withColumn("k", ours).join(keys, "k", "left_semi").select("id", "source", "target")
    edges = graph.edges.join(hit.select("id"), "id", "left_anti")
    touched = hit.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    busy = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    alone = touched.join(busy, "id", "left_anti").join(graph.nodes.filter("kind = 'content' and source = 'extracted'").select("id"), "id", "left_semi")
    return Graph(graph.nodes.join(alone, "id", "left_anti"), edges, graph.rejects, graph.now_ms)


def re_extract(graph: Graph, chunks: DataFrame, stored: DataFrame, adapter: Adapter, ontology: Ontology) -> tuple[Graph, DataFrame, dict[str, int], JobStatus]:
    """(graph, hashes, counts by status, job): deleted chunks are pruned, new and changed ones extracted again."""
    diff = cut(document_diff(chunks, stored))
    counts = {s: 0 for s in ("new", "changed", "unchanged", "deleted")} | {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
    gone = diff.filter("status = 'deleted'").select("doc_id", "chunk_id")
    kept = stored.join(gone, ["doc_id", "chunk_id"], "left_anti")
    todo = chunks.join(diff.filter("status in ('new', 'changed')").select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")
    made, hashes, _, status = run_job(without_chunks(graph, gone), todo, kept, adapter, ontology)
    return made, hashes, counts, status


def re_extract_corpus(
    graph: Graph, chunks: DataFrame, stored: DataFrame, adapter: Adapter, ontology: Ontology, doc_ids: Sequence[str] | None = None, done: DataFrame | None = None
) -> tuple[Graph, DataFrame, DataFrame, str]:
    """re_extract over all documents at once: (graph, hashes, manifest(doc_id, status), status). done(doc_id, status) resumes a job: documents
    that are completed or skipped aren't taken again. completed without failures, failed without successes, else completed_with_errors."""
    rows = chunks if doc_ids is None else chunks.filter(F.col("doc_id").isin(list(doc_ids)))
    own = stored if doc_ids is None else stored.filter(F.col("doc_id").isin(list(doc_ids)))
    if done is not None:
        over = done.filter("status in ('completed', 'skipped')").select("doc_id")
        rows, own = rows.join(over, "doc_id", "left_anti"), own.join(over, "doc_id", "left_anti")
    rest = stored.join(own.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
    made, hashes, _, _ = re_extract(graph, rows, own, adapter, ontology)
    now = chunk_hashes(rows).join(hashes, ["doc_id", "chunk_id", "hash"], "left").join(hashes.select("doc_id", "chunk_id", "hash").withColumn("ok", F.lit(1)), ["doc_id", "chunk_id", "hash"], "left")
    manifest = now.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == F.count("ok"), "completed").otherwise("failed").alias("status"))
    if done is not None:
        manifest = manifest.unionByName(done.select("doc_id", "status").join(manifest.select("doc_id"), "doc_id", "left_anti"))
    tally = {r["status"]: r["count"] for r in manifest.groupBy("status").count().collect()}
    good = tally.get("completed", 0) + tally.get("skipped", 0)
    status = "completed" if not tally.get("failed") else "failed" if not good else "completed_with_errors"
    return made, hashes.unionByName(rest), manifest, status


def estimated_tokens(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN) + PROMPT_TOKENS
