"""Token ids in bit-plane shuffled, zstandard-compressed chunks with an index.

Format. A store is a folder with two Parquet tables, so that any file system that Spark reaches can hold it:
``chunks`` (shard, chunk, payload) and ``index`` (shard, chunk, doc_ids, lengths, n_tokens, n_blocks, n_bytes, crc32).
A chunk holds whole documents. Its payload is a header of little-endian unsigned 32-bit integers - magic, version,
ids in a block, ids in all, blocks, then the byte length of every plane of every block - followed by the planes. A block's
ids, as unsigned 32-bit integers, are transposed into 32 bit planes (or 4 byte planes), least significant first, and each
plane is one zstandard frame; the last block is filled up with zeros. Shards are in order of doc_id, and so are the chunks
of a shard and the documents of a chunk.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.bpe import Halves
from quillon.llm.common import by_bytes, shared_dir, text_of

MAGIC, VERSION = 0x51425031, 1
BLOCK_IDS = 16384
#: A chunk ends with the document that brings it to this many ids.
CHUNK_IDS = 131072
#: Bytes of texts encoded at a time; a longer text goes alone.
CALL_BYTES = 1 << 24
#: Stretches kept per worker from one call to the next; one that has gone is encoded again.
CACHE_PIECES = 1_000_000
MARKS = ",.;:!?"
#: Letters of scripts that any version of the library knows for letters, and one mark.
LETTERS_AND_MARK = rf"\A[A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{17f}}\x{{391}}-\x{{3a1}}\x{{3b1}}-\x{{3c9}}\x{{410}}-\x{{44f}}]+[{MARKS}]\z"
INDEX = "shard int, chunk int, doc_ids array<long>, lengths array<long>, n_tokens long, n_blocks int, n_bytes long, crc32 long"


class Pieces:
    """The ids of texts, as little-endian bytes; each different stretch is encoded once by the tokenizers library.

    Cutting at single spaces is right only for a byte-level pre-tokenizer that splits by its own pattern and has no normalizer
    before it; for any other tokenizer file every text is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        other = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
        #: What makes cutting at spaces unsafe: other white space, or white space beside white space or at an end.
        self.odd = "|".join([f"[{other}]", r"[ \n][ \n]", r"\A[ \n]", r"[ \n]\z", *special]) if plain else "(?s)."
        #: Known stretches without their leading space, and where the ids of each stand in table; the oldest go first.
        self.words = pa.array([], pa.string())
        self.table, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.heads = Halves(self.whole, CACHE_PIECES // 8)
        self.marks = pa.array(list(MARKS))
        self.mark_ids = [np.frombuffer(self.whole(m), "<u4") for m in MARKS]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes stretches that come up anew, those of letters alone as one text with a space before each."""
        letters, rest = [], []
        for word in words:
            (letters if word.isalpha() else rest).append(word)
        names, tables, lengths = [], [self.table], [self.lengths]
        for at in range(0, len(letters), 20_000):
            part = letters[at : at + 20_000]
            found = self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False)
            of = np.array(found.word_ids, np.int64)
            if len(of) and of[-1] + 1 == len(part) and (np.diff(of) >= 0).all():
                names += part
                tables.append(np.array(found.ids, "<u4"))
                lengths.append(np.bincount(of, minlength=len(part)))
            else:  # the library takes some of these characters for no letters
                rest += part
        found = [x.ids for x in self.tokenizer.encode_batch_fast([" " + w for w in rest], add_special_tokens=False)]
        tables += [np.array(x, "<u4") for x in found]
        lengths.append(np.array([len(x) for x in found], np.int64))
        self.words = pa.concat_arrays([self.words, pa.array(names + rest, pa.string())])
        self.table, self.lengths = np.concatenate(tables), np.concatenate(lengths)

    def forget(self) -> None:
        if (gone := len(self.words) - CACHE_PIECES) > 0:
            self.table = self.table[int(self.lengths[:gone].sum()) :].copy()
            self.words, self.lengths = pa.concat_arrays([self.words.slice(gone)]), self.lengths[gone:].copy()

    def pieces_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches behind a space, end to end, and how many each has.

        A run of letters with one mark behind it is two words to the library, whatever they are.
        """
        marked = pc.match_substring_regex(words, LETTERS_AND_MARK)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, stop=-1), words)
        mark = pc.if_else(marked, pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=self.marks), -1).to_numpy(zero_copy_only=False)
        self.forget()
        found = pc.index_in(stems, value_set=self.words)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            n, new = len(self.words), stems.filter(pc.is_null(found))
            self.learn(new.unique().to_pylist())
            at[pc.is_null(found).to_numpy(zero_copy_only=False)] = n + pc.index_in(new, value_set=self.words.slice(n)).to_numpy()
        base = self.lengths[at]
        out_lengths = base + np.array([len(x) for x in self.mark_ids] + [0])[mark]
        starts = np.cumsum(out_lengths) - out_lengths
        out = np.empty(int(out_lengths.sum()), "<u4")
        ids = laid_out(self.table, (np.cumsum(self.lengths) - self.lengths)[at], base)
        inner = np.ones(len(out), bool)
        for k, own in enumerate(self.mark_ids):
            where = (starts + base)[mark == k]
            for j, i in enumerate(own):
                out[where + j] = i
                inner[where + j] = False
        out[inner] = ids
        return out, out_lengths

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Texts are cut at single spaces between two other characters, where the library's own cuts always lie.

        Arrow splits them, numbers the different stretches and finds those known; numpy lays out their ids. Python sees new ones only.
        """
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        out: list[bytes] = [b""] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.whole(texts[k].as_py())
        if not len(plain):
            return out
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        ends = np.cumsum(pc.list_value_length(parts).to_numpy().astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        flat = parts.flatten()
        first = np.zeros(len(flat), bool)
        first[starts] = True
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        heads = flat.take(pa.array(starts)).dictionary_encode()
        table, lengths = self.pieces_of(rest.dictionary)
        openings = [np.frombuffer(self.heads[w], "<u4") for w in heads.dictionary.to_pylist()]
        table = np.concatenate([table, *openings])
        lengths = np.concatenate([lengths, np.array([len(x) for x in openings], np.int64)])
        code = np.empty(len(flat), np.int32)
        code[~first] = rest.indices.to_numpy()
        code[first] = heads.indices.to_numpy() + len(rest.dictionary)
        own = lengths[code]
        ids = laid_out(table, (np.cumsum(lengths) - lengths)[code], own).tobytes()
        cuts = np.concatenate([[0], np.cumsum(own)])
        for k, a, b in zip(plain.tolist(), (4 * cuts[starts]).tolist(), (4 * cuts[ends]).tolist(), strict=True):
            out[k] = ids[a:b]
        return out


def laid_out(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs table[start : start + length], end to end."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return table[at]


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One encoder per tokenizer file and worker, so that later tasks of the worker find its cache warm."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def planes(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """The planes of one block of ids, least significant first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits(raw[:, k // 8] >> (k % 8) & 1, bitorder="little").tobytes() for k in range(32)]


def unplanes(parts: list[bytes], n: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, part in enumerate(parts):
        plane = np.frombuffer(part, np.uint8)
        if len(parts) == 4:
            raw[:, k] = plane
        elif plane.any():
            raw[:, k // 8] |= np.unpackbits(plane, count=n, bitorder="little") << (k % 8)
    return raw.reshape(-1).view("<u4")


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = True) -> bytes:
    """A chunk's payload; block_ids must be a multiple of 8."""
    squeeze = zstandard.ZstdCompressor(level=3)
    blocks = -(-len(ids) // block_ids)
    filled = np.zeros(blocks * block_ids, "<u4")
    filled[: len(ids)] = ids
    parts = [squeeze.compress(p) for b in range(blocks) for p in planes(filled[b * block_ids : (b + 1) * block_ids], bits)]
    head = [MAGIC, VERSION, block_ids, len(ids), blocks, *map(len, parts)]
    return np.array(head, "<u4").tobytes() + b"".join(parts)


def unpack(payload: bytes) -> np.ndarray:
    magic, version, block_ids, n, blocks = np.frombuffer(payload, "<u4", 5).tolist()
    if magic != MAGIC or version != VERSION:
        raise ValueError("no token chunk of this version")
    rest = int(np.frombuffer(payload, "<u4", 6)[5]) if blocks else 0
    # 32 or 4 planes a block: only one count makes the lengths add up
    for each in (32, 4):
        head = 20 + 4 * each * blocks
        if head > len(payload):
            continue
        lengths = np.frombuffer(payload, "<u4", each * blocks, 20).astype(np.int64)
        if head + int(lengths.sum()) == len(payload):
            break
    else:
        raise ValueError(f"a damaged token chunk ({rest})")
    ends = head + np.cumsum(lengths)
    grow = zstandard.ZstdDecompressor()
    out = []
    for b in range(blocks):
        parts = [grow.decompress(payload[int(ends[k] - lengths[k]) : int(ends[k])]) for k in range(each * b, each * (b + 1))]
        out.append(unplanes(parts, block_ids))
    return np.concatenate(out)[:n] if out else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id to each and writes the store.

    Documents are ordered by id, then text; null ids come first; null text counts as empty and is end_id alone. A text
    of any length stays in one chunk. An empty table gives a store without chunks. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk = TaskContext.get().partitionId(), 0
        pieces = loaded(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        ids, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(parts), "<u4")
            payload = pack(flat)
            row = (shard, chunk, list(ids), list(lengths), len(flat), -(-len(flat) // BLOCK_IDS), len(payload), zlib.crc32(payload), payload)
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ("shard", "chunk", "doc_ids", "lengths", "n_tokens", "n_blocks", "n_bytes", "crc32", "payload")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for piece in by_bytes(batch, 1, CALL_BYTES):
                for doc_id, encoded in zip(piece.column(0).to_pylist(), pieces.encode(piece.column(1)), strict=True):
                    raw = encoded + end
                    ids.append(doc_id)
                    lengths.append(len(raw) // 4)
                    parts.append(raw)
                    held += len(raw) // 4
                    if held >= CHUNK_IDS:
                        yield close()
                        ids, lengths, parts, held = [], [], [], 0
                        chunk += 1
        if ids:
            yield close()

    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ordered = slim.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(run, f"{INDEX}, payload binary")
    made.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{folder}/chunks")
    spark.read.parquet(f"{folder}/chunks").drop("payload").write.mode("overwrite").parquet(f"{folder}/index")


def read_tokens(spark, folder: str, full: bool = False) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32; with full also ids."""
    index = spark.read.parquet(f"{folder}/index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard, of which there are as many as writing tasks
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("shard_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(shards, "shard")
    starts = starts.select("shard", "chunk", (F.col("shard_start") + F.col("inner")).alias("at"), F.col("crc32").alias("crc"), "doc_ids", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["crc"]:
                    raise ValueError(f"chunk {row['chunk']} of shard {row['shard']} is damaged")
                flat = unpack(row["payload"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                cuts = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["at"] + ends - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in cuts], pa.int64()),
                }
                if full:
                    columns["ids"] = pa.array([flat[a:b].tolist() for a, b in cuts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    chunks = spark.read.parquet(f"{folder}/chunks").select("shard", "chunk", "payload")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if full else "")
    return chunks.join(starts, ["shard", "chunk"]).mapInArrow(run, schema)


def stored_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes a new store in the shared folder and reads it back."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, folder, end_id)
    return read_tokens(docs.sparkSession, folder)
