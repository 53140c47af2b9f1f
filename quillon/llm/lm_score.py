"""Cross-entropy difference of two matched bigram models.

The target model counts the target documents, the background model all documents. Both share one vocabulary (every word
that occurs), one order and one smoothing. A document's score is the mean over its tokens of the target model's loss less
the background model's.

Counts of words and of pairs are exact and grow with the corpus, so they stay distributed. Each task reads its documents
as blocks, and asks for the counts of a block's different words and pairs, by 64-bit hash, in slots; a slot adds up what
all blocks have of its words and pairs and answers each block with the totals. The answers meet the block's documents
again by its number, and nothing goes through the driver.

vocabulary, count and difference are the form with tables of fixed size, which lm_scores doesn't use.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import Halves
from quillon.llm.common import WORD, cut, text_of

VOCABULARY = 65535
#: Bigram slots, a power of two, and the slices that they travel in.
SLOTS = 1 << 20
SLICES = 64
#: The weight of the bigram estimate where its history has been seen, and what each word's unigram count gains.
MIX, GAIN = 0.7, 0.5
TOKEN = re.compile(WORD)
MIXER = np.uint64(0x9E3779B97F4A7C15)


def slots(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    key = (first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)) * MIXER
    return ((key ^ key >> np.uint64(29)) * MIXER >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)


def vocabulary(docs: DataFrame, text_col: str = "text", most: int = VOCABULARY) -> list[str]:
    """The most frequent words of all documents; ties go to the smaller word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counted.update(tokens(text.as_py()))
                if len(counted) >= 400_000:
                    yield pa.RecordBatch.from_pydict({"word": list(counted), "n": list(counted.values())})
                    counted.clear()
        if counted:
            yield pa.RecordBatch.from_pydict({"word": list(counted), "n": list(counted.values())})

    counts = docs.select(text_of(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    # The count that the last of them has, from how many words have each count; then only those words are fetched.
    spectrum = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upto = spectrum.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("n"))))  # one row for each different count
    bound = upto.filter(F.col("upto") <= most).agg(F.min("n").alias("least"), F.max("upto").alias("taken")).first()
    sure = counts.filter(F.col("n") >= (bound["least"] or 2**62))
    edge = upto.filter(F.col("upto") > most).agg(F.max("n").alias("n")).first()["n"]
    words = [(-r["n"], r["word"]) for r in sure.collect()]
    if edge is not None and len(words) < most:
        room = most - len(words)
        words += [(-edge, r["word"]) for r in counts.filter(F.col("n") == edge).orderBy("word").limit(room).collect()]
    return [w for _, w in sorted(words)]


def tokens(text: str) -> list[str]:
    """The runs of characters outside [\\x20\\x09-\\x0D]."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return TOKEN.findall(text)


class Models:
    """Counts of the two models, row 0 background and row 1 target, over words and over bigram slots."""

    def __init__(self, words: list[str], unigrams: np.ndarray, bigrams: np.ndarray):
        self.words = {w: k + 1 for k, w in enumerate(words)}
        self.unigrams, self.bigrams = unigrams, bigrams
        self.p = (unigrams + GAIN) / (unigrams.sum(1, keepdims=True) + GAIN * unigrams.shape[1])

    def reader(self) -> Halves:
        known = self.words
        return Halves(lambda w: known.get(w, 0))

    def losses(self, text: str, ids: Halves) -> tuple[int, float, float]:
        """(tokens, target loss per token, background loss per token), in bits; 0 for a text without tokens."""
        words = np.array([ids[w] for w in tokens(text)], np.int64)
        if not len(words):
            return 0, 0.0, 0.0
        at = slots(words[:-1], words[1:], self.bigrams.shape[1])
        out = []
        for which in (1, 0):
            p = self.p[which][words].copy()
            seen = self.unigrams[which][words[:-1]]
            pair = np.minimum(self.bigrams[which][at], seen)
            p[1:] = np.where(seen > 0, MIX * pair / np.maximum(seen, 1) + (1 - MIX) * p[1:], p[1:])
            out.append(float(-np.log2(p).mean()))
        return len(words), out[0], out[1]


def count(docs: DataFrame, target_ids: DataFrame, words: list[str], n_slots: int = SLOTS) -> Models:
    """Counts all documents for the background and those with an id in target_ids for the target as well."""
    session = docs.sparkSession
    broadcast = session.sparkContext.broadcast(words)  # at most VOCABULARY words
    size = len(words) + 1
    each, each_words = -(-n_slots // SLICES), -(-size // SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: k + 1 for k, w in enumerate(broadcast.value)}
        ids = Halves(lambda w: known.get(w, 0))
        uni, bi = np.zeros((2, each_words * SLICES), np.int64), np.zeros((2, each * SLICES), np.int64)
        held: list[list[np.ndarray]] = [[], []]

        def add() -> None:
            for which, parts in enumerate(held):
                if parts:
                    flat = np.concatenate(parts)
                    pairs = (flat[:-1] >= 0) & (flat[1:] >= 0)
                    uni[which] += np.bincount(flat[flat >= 0], minlength=uni.shape[1])
                    bi[which] += np.bincount(slots(flat[:-1][pairs], flat[1:][pairs], n_slots), minlength=bi.shape[1])
                    parts.clear()

        n = 0
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                line = np.array([ids[w] for w in tokens(text.as_py())] + [-1], np.int64)
                held[0].append(line)
                if target:
                    held[1].append(line)
                n += len(line)
                if n >= 2_000_000:
                    add()
                    n = 0
        add()
        for which in (0, 1):
            for k in range(SLICES):
                for kind, table, width in ((0, uni, each_words), (1, bi, each)):
                    part = table[which, k * width : (k + 1) * width]
                    if len(places := np.flatnonzero(part)):
                        yield pa.RecordBatch.from_pydict(
                            {"which": [which], "kind": [kind], "slice": [k], "places": [places.astype("<i4").tobytes()], "counts": [part[places].astype("<i8").tobytes()]}
                        )

    def total(pdf):
        import pandas as pd

        width = each if pdf["kind"].iloc[0] else each_words
        out = np.zeros(width, np.int64)
        for places, counts in zip(pdf["places"], pdf["counts"], strict=True):
            out[np.frombuffer(places, "<i4")] += np.frombuffer(counts, "<i8")
        return pd.DataFrame({"which": pdf["which"].iloc[:1], "kind": pdf["kind"].iloc[:1], "slice": pdf["slice"].iloc[:1], "counts": [out.tobytes()]})

    wanted = target_ids.select(F.col("doc_id").cast("long").alias("__target")).dropna().distinct()
    slim = docs.select(F.col("doc_id").cast("long").alias("__id"), text_of("text").alias("text"))
    # the targets grow with the corpus, so neither side is broadcast at any size
    marked = slim.join(wanted.hint("merge"), F.col("__id") == F.col("__target"), "left").select("text", F.col("__target").isNotNull().alias("target"))
    rows = marked.mapInArrow(run, "which long, kind long, slice long, places binary, counts binary")
    # a group has one row for each task that counted
    sums = rows.groupBy("which", "kind", "slice").applyInPandas(total, "which long, kind long, slice long, counts binary").collect()
    uni, bi = np.zeros((2, each_words * SLICES), np.int64), np.zeros((2, each * SLICES), np.int64)
    for r in sums:
        table, width = (bi, each) if r["kind"] else (uni, each_words)
        table[r["which"], r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return Models(words, uni[:, :size], bi[:, :n_slots])


def difference(docs: DataFrame, models: Models) -> DataFrame:
    """One row per input row: doc_id, n_tokens, target_loss, background_loss, score (their difference).

    A lower score is more like the target. Null text counts as empty; a text without tokens scores 0; any text is read
    whole; null and repeated ids are kept. Other columns play no part.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(models)  # a vocabulary and two tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = broadcast.value
        ids = models.reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                n, target, background = zip(*(models.losses(t.as_py(), ids) for t in piece.column(1)), strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": piece.column(0), "n_tokens": list(n), "target_loss": list(target), "background_loss": list(background), "score": [a - b for a, b in zip(target, background, strict=True)]}
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


#: Tokens after which a block ends, and the slots at least that its words and pairs are asked for in.
BLOCK = 4_000_000
LEAST_SLOTS = 1024
PARTS = "slot long, block long, parts array<binary>"


def packed(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not x:
        return np.zeros(0, kind)
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def shortened(keys: np.ndarray) -> bytes:
    """Keys less their lowest byte. For a word the slot tells the rest; for a pair it adds 10 bits of its own."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()


def lengthened(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 7, 8), np.uint8)
    out[:, 1:] = np.frombuffer(x, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def word_keys(words) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words), "<u8")


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    key = (first ^ first >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ key >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (key ^ key >> np.uint64(31)) + second


class Block:
    """Documents as numbers of words, with the block's different pairs. Words and pairs are ordered by slot, which follows from
    the low 16 bits of the words' keys."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, codes: np.ndarray, n_slots: int):
        self.words, self.lengths = words, lengths
        starts = np.cumsum(lengths) - lengths
        self.later = np.ones(len(words), bool)  # tokens with a history
        self.later[starts[lengths > 0]] = False
        at = np.flatnonzero(self.later)
        self.pairs, self.pair = np.unique(words[at - 1].astype(np.int64) << 32 | words[at].astype(np.int64), return_inverse=True)
        self.first, self.second = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        codes = codes.astype(np.uint64)
        of_word = (codes % np.uint64(n_slots)).astype(np.int64)
        of_pair = ((codes[self.first] << np.uint64(16) | codes[self.second]) * MIXER >> np.uint64(32)).astype(np.int64) % n_slots
        self.word_order, self.pair_order = np.argsort(of_word, kind="stable"), np.argsort(of_pair, kind="stable")
        self.word_ends, self.pair_ends = np.cumsum(np.bincount(of_word, minlength=n_slots)), np.cumsum(np.bincount(of_pair, minlength=n_slots))


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with the text compressed, which halves what the join with the targets moves."""
    for batch in batches:
        bodies = [packed(np.frombuffer(x.as_buffer(), np.uint8)) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["doc_id", "body"])


def asked(batches: Iterator[pa.RecordBatch], n_slots: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, body, target) to rows of PARTS: for each block its documents, under a negative slot, and a question to every slot."""
    task, serial = TaskContext.get().partitionId(), 0
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    lines, docs, targets, held = [], [], [], 0

    def ended() -> Iterator[pa.RecordBatch]:
        block = task << 24 | serial
        lengths = np.array([len(x) for x in lines], np.int64)
        words = np.concatenate([np.zeros(0, np.int32), *lines])
        of_target = np.repeat(np.array(targets, bool), lengths)
        # the more frequent a word, the smaller its number, which compresses better
        order = np.argsort(-np.bincount(words, minlength=len(numbers)), kind="stable")
        renamed = np.empty(len(order), np.int32)
        renamed[order] = np.arange(len(order))
        words, keys = renamed[words], word_keys(numbers)[order]
        codes = (keys & np.uint64(0xFFFF)).astype("<u2")
        b = Block(words, lengths, codes, n_slots)
        there = np.array([d is not None for d in docs], "<u1")
        ids = np.array([d or 0 for d in docs], "<i8")
        yield pa.RecordBatch.from_pydict(
            {"slot": [-1 - block], "block": [block], "parts": [[packed(there), packed(ids), packed(lengths), packed(words.astype("<i4")), packed(codes)]]}, pa.schema(SCHEMA)
        )
        n, t = (np.bincount(x, minlength=len(keys))[b.word_order] for x in (words, words[of_target]))
        pn, pt = (np.bincount(x, minlength=len(b.pairs))[b.pair_order] for x in (b.pair, b.pair[of_target[b.later]]))
        pairs = pair_keys(keys[b.first], keys[b.second])[b.pair_order]
        keys = keys[b.word_order]
        rows, w, p = [], 0, 0
        for k in range(n_slots):
            w, was, p, were = int(b.word_ends[k]), w, int(b.pair_ends[k]), p
            rows.append([shortened(keys[was:w]), packed(n[was:w]), packed(t[was:w]), shortened(pairs[were:p]), packed(pn[were:p]), packed(pt[were:p])])
            if len(rows) == 128 or k == n_slots - 1:
                slot = np.arange(k + 1 - len(rows), k + 1)
                yield pa.RecordBatch.from_pydict({"slot": slot, "block": np.full(len(rows), block), "parts": rows}, pa.schema(SCHEMA))
                rows = []

    for batch in batches:
        for doc, body, target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            found = tokens(unpacked(body.as_py(), "<u1").tobytes().decode())
            lines.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            docs.append(doc)
            targets.append(target)
            held += len(found)
            if held >= BLOCK or len(docs) >= BLOCK:
                yield from ended()
                serial, held = serial + 1, 0
                for x in (lines, docs, targets, numbers):
                    x.clear()
    if docs:
        yield from ended()


SCHEMA = [("slot", pa.int64()), ("block", pa.int64()), ("parts", pa.list_(pa.binary()))]


def answered(key: tuple, table: pa.Table) -> pa.Table:
    """All questions to one slot, each answered by the totals of its words and pairs and by what the slot adds to the corpus'
    different words and tokens. Documents pass."""
    if key[0].as_py() < 0:
        return table
    rows = table["parts"].to_pylist()
    answers: list[list[bytes]] = [[] for _ in rows]
    sums = []
    for at in (0, 3):
        keys = [lengthened(r[at]) for r in rows]
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(x) for x in keys])[:-1]
        for kind in (1, 2):
            total = np.bincount(place, np.concatenate([unpacked(r[at + kind], "<i8") for r in rows]), len(different)).astype("<i8")  # exact below 2^53
            for answer, part in zip(answers, np.split(total[place], ends), strict=True):
                answer.append(packed(part))
            if not at:
                sums.append(int(total.sum()))
        if not at:
            sums.insert(0, len(different))
    corpus = packed(np.array(sums, "<i8"))
    return pa.Table.from_pydict({"slot": table["slot"], "block": table["block"], "parts": [[*x, corpus] for x in answers]}, pa.schema(SCHEMA))


def judged(table: pa.Table, n_slots: int) -> pa.Table:
    """One block's documents and answers to (doc_id, n_tokens, target_loss, background_loss, score)."""
    rows = [r["parts"] for r in sorted(table.to_pylist(), key=lambda r: r["slot"])]
    there, ids, lengths, words, codes = (unpacked(x, kind) for x, kind in zip(rows[0], ("<u1", "<i8", "<i8", "<i4", "<u2"), strict=True))
    answers = rows[1:]
    if len(answers) != n_slots:
        raise RuntimeError(f"{len(answers)} answers of {n_slots}")
    corpus = sum(unpacked(r[4], "<i8") for r in answers)
    b = Block(words, lengths, codes, n_slots)
    of_doc = np.repeat(np.arange(len(lengths)), lengths)
    out = []
    for which in (1, 0):
        of_word, of_pair = np.zeros(len(codes), np.int64), np.zeros(len(b.pairs), np.int64)
        of_word[b.word_order] = np.concatenate([unpacked(r[which], "<i8") for r in answers])
        of_pair[b.pair_order] = np.concatenate([unpacked(r[2 + which], "<i8") for r in answers])
        p = ((of_word + GAIN) / (corpus[1 + which] + GAIN * corpus[0]))[words] if len(words) else np.zeros(0)
        seen, pair = of_word[b.first], of_pair
        mixed = np.where(seen > 0, MIX * pair / np.maximum(seen, 1), 0.0)[b.pair]
        p[b.later] = np.where((seen > 0)[b.pair], mixed + (1 - MIX) * p[b.later], p[b.later])
        out.append(np.bincount(of_doc, -np.log2(p), len(lengths)) / np.maximum(lengths, 1))
    return pa.table({"doc_id": pa.array(ids, mask=there == 0), "n_tokens": lengths, "target_loss": out[0], "background_loss": out[1], "score": out[0] - out[1]})


def lm_scores(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Counts both models over docs and scores docs with them; a row as difference gives it.

    A word or pair is told apart by 64 bits of hash or more. A word that the target lacks has GAIN there, as every word has.
    """
    n_slots = min(1 << 16, max(LEAST_SLOTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("__target")).dropna().distinct()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(squeezed, "doc_id long, body binary")
    # the targets grow with the corpus, so neither side is broadcast at any size
    marked = slim.join(wanted.hint("merge"), F.col("doc_id") == F.col("__target"), "left").select("doc_id", "body", F.col("__target").isNotNull().alias("target"))
    answers = marked.mapInArrow(lambda batches: asked(batches, n_slots), PARTS).groupBy("slot").applyInArrow(answered, PARTS)
    return answers.groupBy("block").applyInArrow(lambda table: judged(table, n_slots), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
