"""The column operator over lossless WebP: texts become pixels, are stored, read back and measured."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import by_bytes, text_of
from quillon.llm.webp_lanes import IMAGE_BYTES, decoded, encoded

ROW_BYTES = 192
#: Bytes of texts taken at a time (a longer text goes alone), and the images that go through the lanes together.
CALL_BYTES, STORE_IMAGES, LOAD_IMAGES = 6 << 20, 600, 2400


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, whose length is a multiple of 192, as WebP files of 64 pixels a row and up to 32 rows, one after the other."""
    cuts = [(k, at) for k, x in enumerate(payloads) for at in range(0, len(x), IMAGE_BYTES)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for part in (cuts[k : k + STORE_IMAGES] for k in range(0, len(cuts), STORE_IMAGES)):
        for (k, _), file in zip(part, encoded([payloads[k][at : at + IMAGE_BYTES] for k, at in part]), strict=True):
            out[k].append(file)
    return [b"".join(x) for x in out]


def load(stored: list[bytes]) -> list[bytes]:
    """The payloads that store was given."""
    files, owners = [], []
    for k, x in enumerate(stored):
        at = 0
        while at < len(x):
            size = 8 + int.from_bytes(x[at + 4 : at + 8], "little")
            files.append(x[at : at + size])
            owners.append(k)
            at += size
    out: list[list[bytes]] = [[] for _ in stored]
    for at in range(0, len(files), LOAD_IMAGES):
        for k, pixels in zip(owners[at : at + LOAD_IMAGES], decoded(files[at : at + LOAD_IMAGES]), strict=True):
            out[k].append(pixels)
    return [b"".join(x) for x in out]


def features(payload: bytes) -> str:
    """Rows, mean, variance and the counts of eight equal ranges of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x >> 5, minlength=8)
    mean = float(x.mean())
    spread = float((counts_256 := np.bincount(x, minlength=256)) @ (np.arange(256) - mean) ** 2 / counts_256.sum())
    return f"rows={len(x) // ROW_BYTES};mean={mean:.6f};var={spread:.6f};hist=" + ",".join(map(str, counts))


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b" " * (ROW_BYTES - len(raw) if not raw else -len(raw) % ROW_BYTES)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per input row with the digests of its stored form; with full also media, the stored bytes.

    The text's UTF-8 bytes, filled with spaces to a positive multiple of 192, are written as lossless WebP (a file for
    every 32 rows of 64 pixels, one after the other), read back and measured. Null text counts as empty; equal texts give
    equal values; rows with the same or a null id are kept. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
        for batch in batches:
            for piece in by_bytes(batch, 1, CALL_BYTES):
                made = [padded(text) for text in piece.column(1).to_pylist()]
                stored = store([payload for _, payload in made])
                rows = []
                for (n, _), media_of, back in zip(made, stored, load(stored), strict=True):
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media_of), hashlib.sha256(media_of).hexdigest(), features(back))
                    rows.append((*row, media_of) if full else row)
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column(0), **dict(zip(names, map(list, zip(*rows, strict=True)), strict=False))})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return slim.mapInArrow(run, schema + (", media binary" if full else ""))
