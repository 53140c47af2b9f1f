"""Byte-pair encoding and decoding with a priority queue of merges over a linked list of symbols.

The operator reads a tokenizer file (vocabulary, ranked merges, end-of-word suffix, special tokens) and applies it
in Arrow batches. A word's symbols form a doubly linked list; a heap holds the ranks of adjacent pairs, and an entry
whose symbols have changed since it was pushed is skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import keeps, release, text_of

#: Words kept per worker with their encoding, twice: when the young half is full it becomes the old one, from which
#: what is met again moves back. A word that has gone is encoded again, which costs time only.
CACHE_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


SEPARATORS = re.compile("[\x1c-\x1f]")
#: Longer stretches aren't kept.
CACHE_LONGEST = 64


class Halves(dict):
    """A bounded cache of make(key) in two halves; it is itself the young half."""

    def __init__(self, make, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= CACHE_LONGEST:
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        """Empties both halves."""
        self.clear()
        self.old = {}


class WordBpe:
    """A byte-level BPE over words with an end-of-word suffix, as its tokenizer file describes it."""

    def __init__(self, spec: str):
        file = json.loads(spec)
        model = file["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes = byte_symbols()
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.strings |= {i: s for s, i in self.special.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        steps = file["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.chunks = Halves(self._chunk)

    def normalize(self, text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is no exception)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """Stretches without white space; the separators U+001C to U+001F, at which str.split cuts too, are none."""
        return [c for c in regex.split(r"\s+", text) if c] if SEPARATORS.search(text) else text.split()

    def word_ids(self, word: str) -> list[int]:
        marks = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        marks[-1] += self.suffix
        ids = [self.vocab[m] for m in marks if m in self.vocab]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        heap = []
        for i in range(n - 1):
            if (m := merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue  # stale: one of its symbols has been merged since
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _chunk(self, chunk: str) -> tuple[str, str, int]:
        """(ids as text, their strings, how many) of a stretch without white space."""
        words = [chunk] if chunk.isalpha() else self.words.findall(chunk)
        if words == [chunk]:
            ids = self.word_ids(chunk)
            return (" ".join(map(str, ids)), self.decode(ids), len(ids))
        found = [self.chunks[w] for w in words]
        return (" ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum([f[2] for f in found]))

    def encode_text(self, text: str) -> list[tuple[str, str, int]]:
        """The pieces of a text in order, each as (ids as text, their strings, how many); none is empty."""
        parts = self.apart.split(text) if self.apart is not None and any(s in text for s in self.special) else [text]
        out = []
        chunks = self.chunks
        for k, part in enumerate(parts):
            if k % 2:
                i = self.special[part]
                out.append((str(i), part, 1))
            else:
                out += [chunks[c] for c in self.split(self.normalize(part))]
        return [f for f in out if f[2]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.encode_text(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ids, one space apart, as a tokenizer without a decoder step joins them."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


_LOADED: dict[str, WordBpe] = {}
keeps("bpe", _LOADED, _LOADED.clear)


def loaded(spec: str) -> WordBpe:
    """One encoder per tokenizer file and worker, so that later tasks of the worker find its cache warm."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def encoded(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with full also ids (text) and decoded.

    spec is the content of a tokenizer file. Null text counts as empty and gives no ids; a word of any length is
    encoded whole; rows with the same id are encoded separately; a null id is kept. Other columns play no part.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file, whose size is fixed
    extra = ", ids string, decoded string" if full else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("bpe")
        bpe = loaded(broadcast.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for text in piece.column(1):
                    found = bpe.encode_text(text.as_py())
                    ids, decoded = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
                    out["n_tokens"].append(sum([f[2] for f in found]))
                    out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if full:
                        out["ids"].append(ids)
                        out["decoded"].append(decoded)
                columns = {"doc_id": piece.column(0), **{k: v for k, v in out.items() if full or k not in ("ids", "decoded")}}
                yield pa.RecordBatch.from_pydict(columns)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
