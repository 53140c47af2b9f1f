"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every vocabulary item has a sparse ternary index vector; an item's word vector is the sum of the index vectors of its
neighbours in the training texts plus its own. Words outside the vocabulary stand in by their shape (runs of upper and
lower case letters, digits and marks), so any word has a vector. A document is the mean vector of its words and a few
shares (repeats, shapes). The network is trained in numpy on a bounded sample of labelled rows, and a temperature fitted on
rows held back from training calibrates its probabilities.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import Halves
from quillon.llm.common import keeps, release, text_of

#: The most labelled rows that a model is fitted on; the rows are those of smallest hashed id.
SAMPLE_ROWS = 4000
VOCABULARY = 8192
WIDTH, NONZERO, SPAN = 64, 4, 2
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.01, 1e-4
THRESHOLD = 0.3

LOWER, UPPER, DIGIT = re.compile("[^\\W\\d_A-ZÀ-ÖØ-Þ]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("\\d+")
MARK_RUN = re.compile(r"([^aA0])\1+")
#: The most signs of a shape, and characters, that a word has before it is cut.
SIGNS, LONGEST = 8, 64
RUN = re.compile(f"{LOWER.pattern}|{UPPER.pattern}|{DIGIT.pattern}|(.)\\1*", re.S)


def shape(word: str) -> str:
    """A word's pattern, such as 'Aa.' or 'a##', in which every run is one sign and one of marks two."""
    return "\0" + MARK_RUN.sub(r"\1\1", DIGIT.sub("0", UPPER.sub("A", LOWER.sub("a", word))))


def pieces(word: str) -> tuple[str, ...]:
    """The word in pieces of at most SIGNS signs and LONGEST characters."""
    out, start, signs = [], 0, 0
    for run in RUN.finditer(word):
        for at in range(run.start(), run.end(), LONGEST):
            end = min(at + LONGEST, run.end())
            more = 1 if run[1] is None else min(end - at, 2)
            if at > start and (signs + more > SIGNS or end - start > LONGEST):
                out.append(word[start:at])
                start, signs = at, 0
            signs += more
    return (*out, word[start:])


CUT = Halves(pieces)
keeps("quality", CUT, CUT.forget)


def words_of(text: str) -> list[str]:
    """The words, long ones in pieces, so that every character bears on some word."""
    out: list[str] = []
    for word in text.split():
        if len(word) <= SIGNS:
            out.append(word)
        else:
            out.extend(CUT[word])
    return out


def index_vector(item: str) -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of an item's nonzero entries; they depend on the item alone."""
    rng = np.random.default_rng(zlib.crc32(item.encode("utf-8", "surrogatepass")))
    return rng.choice(WIDTH, NONZERO, replace=False), rng.choice([-1.0, 1.0], NONZERO)


def index_matrix(items: list[str]) -> np.ndarray:
    out = np.zeros((len(items), WIDTH))
    for row, item in enumerate(items):
        places, signs = index_vector(item)
        out[row, places] = signs
    return out


class Model:
    """items: rows of vectors; then the network's weights and the temperature."""

    def __init__(self, items: list[str], vectors: np.ndarray):
        self.items = {item: k for k, item in enumerate(items)}
        self.vectors = vectors.astype(np.float32)
        self.layers: list[np.ndarray] = []
        self.center = self.scale = np.zeros(0)
        self.temperature = 1.0

    def reader(self) -> Halves:
        """From words to rows of vectors."""
        items, other = self.items, len(self.items) - 1
        return Halves(lambda word: items[word] if word in items else items.get(shape(word), other))

    def inputs(self, text: str, rows: Halves) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(WIDTH + 4)
        n = len(words)
        mean = self.vectors[np.array([rows[w] for w in words])].mean(0)
        repeats = sum(map(eq, words, words[1:])) / n
        return np.concatenate([mean, [repeats, len(set(words)) / n, math.log1p(n) / 10, len(text) / n / 10]])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, seed: int = 0) -> Model:
    """A model of label 1 against label 0; with one class or no row, it gives every text that class's share."""
    counted = Counter(w for t in texts for w in words_of(t))
    known = [w for w, n in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= 5]
    inside = set(known)
    items = known + sorted({shape(w) for w in counted if w not in inside}) + ["\0other"]
    index = index_matrix(items)
    model = Model(items, index)
    rows = model.reader()
    places, signs = zip(*(index_vector(i) for i in items), strict=True)
    places, signs = np.array(places), np.array(signs)
    stream = np.concatenate([np.array([rows[w] for w in words_of(t)] + [-1] * SPAN, np.int64) for t in texts] or [np.zeros(0, np.int64)])
    vectors = np.zeros(len(items) * WIDTH)
    for step in range(1, SPAN + 1):
        a, b = stream[:-step], stream[step:]
        both = (a >= 0) & (b >= 0)
        for x, y in ((a[both], b[both]), (b[both], a[both])):
            for k in range(NONZERO):
                vectors += np.bincount(x * WIDTH + places[y, k], signs[y, k], len(vectors))
    vectors = vectors.reshape(-1, WIDTH)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    model.vectors = (vectors / np.maximum(norms, 1e-12) + index / math.sqrt(NONZERO)).astype(np.float32)
    x = np.stack([model.inputs(t, rows) for t in texts]) if texts else np.zeros((0, WIDTH + 4))
    y = labels.astype(float)
    rng = np.random.default_rng(seed)
    model.center, model.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(WIDTH + 4), np.ones(WIDTH + 4))
    share = (y.sum() + 1) / (len(y) + 2)
    model.layers = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([math.log(share / (1 - share))])]
    if len(set(labels.tolist())) < 2:
        return model
    held = rng.random(len(y)) < 0.2
    z, t = ((x - model.center) / model.scale)[~held], y[~held]
    layers = model.layers
    layers[2] = rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN)
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ layers[0] + layers[1])
        p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3][0], -30, 30)))
        d = (p - t) / max(len(t), 1)
        dh = np.outer(d, layers[2]) * (1 - h * h)
        slopes = [z.T @ dh + DECAY * layers[0], dh.sum(0), h.T @ d + DECAY * layers[2], np.array([d.sum()])]
        for k, g in enumerate(slopes):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            layers[k] = layers[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    if held.any():
        raw, truth = model.logits(x[held]), y[held]

        def loss(temperature: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(raw / temperature, -30, 30))), 1e-9, 1 - 1e-9)
            return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

        model.temperature = min((2.0 ** (k / 8) for k in range(-16, 33)), key=lambda c: (loss(c), c))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on at most sample_rows labelled rows that held_out leaves out.

    Rows with a null id or label aren't used; of several labels of one id the smallest counts, and of several texts the first.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .dropna()
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(F.broadcast(wanted), "doc_id").collect()
    rows = {r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]), reverse=True)}
    rows = [rows[k] for k in sorted(rows)]
    model = fit([r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64))
    release()  # of the driver, which only scores where Spark runs in it
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null text counts as empty, which has its own score; any text is read whole; null and repeated ids are kept.
    Nothing but the text bears on a score.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary and network, both of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("quality")
        model = broadcast.value
        rows = model.reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                x = np.stack([model.inputs(t.as_py(), rows) for t in piece.column(2)])
                scores = model.scores(x)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of("text").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that scored predicts to be of label 1."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("quality")
        model = broadcast.value
        rows = model.reader()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, 500):
                x = np.stack([model.inputs(t.as_py() or "", rows) for t in texts.slice(at, 500)])
                yield batch.slice(at, 500).filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
