"""Bulk insertion with options and resumption after a failure."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.collection import Collection
from quillon.streaming.ingest import split_bad


@dataclass(frozen=True)
class BulkOptions:
    """defer_graph leaves optimize() to the caller; checkpoint_every is how many rows a part has, 0 for one part; resume_token goes on where the
    call of that token stopped. The others steer an index or a log that a collection on Parquet doesn't have: they are taken and have no effect."""

    batch_lock_size: int = 0
    defer_graph: bool = False
    wal_flush_every: int = 0
    ef_construction: int = 0
    index_mode: str = "immediate"
    skip_metadata_index: bool = False
    parallel_build: bool = False
    checkpoint_every: int = 0
    resume_token: str | None = None

    def __post_init__(self):
        if self.index_mode not in ("immediate", "deferred"):
            raise ValueError(f"unknown index mode {self.index_mode!r}")
        if min(self.batch_lock_size, self.wal_flush_every, self.ef_construction, self.checkpoint_every) < 0:
            raise ValueError("counts must not be negative")


@dataclass(frozen=True)
class BulkResult:
    inserted: int
    token: str
    errors: DataFrame  # (id, error)


def bulk_insert(collection: Collection, rows: DataFrame, options: BulkOptions | None = None) -> BulkResult:
    """Adds rows(id, embedding, ...) in parts, each recorded in a manifest when it is in; bad rows are errors and don't stop the others.

    With more than one part rows need ids of their own: a part that was cut off between its rows and its record is taken again, and what is there
    already is then no error.
    """
    options = options or BulkOptions()
    spark, token = collection.spark, options.resume_token or uuid.uuid4().hex
    folder = f"{collection.folder}/bulk/{token}"
    fs, path = collection.catalog._fs(folder)
    done: dict[int, dict] = {}
    if fs.exists(path):
        done = {r["part"]: r for r in (json.loads(x["value"]) for x in spark.read.text(f"{folder}/*").collect())}  # a line per part
    elif options.resume_token:
        raise KeyError(f"no bulk insertion {token}")
    parts = next(iter(done.values()))["parts"] if done else max(1, -(-rows.count() // options.checkpoint_every)) if options.checkpoint_every else 1
    if parts > 1 and not rows.filter("coalesce(id, 0) <= 0").isEmpty():
        raise ValueError("rows of a bulk insertion in parts need ids")
    inserted, errors = sum(r["inserted"] for r in done.values()), spark.createDataFrame([], "id long, error string")
    for n in range(parts):
        if n in done:
            continue
        part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == n)
        if options.resume_token:
            part = part.join(collection.load().select("id"), "id", "left_anti")
        good, bad = split_bad(part, collection.load(), collection.config.dimension)
        count = good.count()
        if count:
            collection.insert(good)
        errors = errors.unionByName(bad.select("id", "error"))
        inserted += count
        line = json.dumps({"part": n, "parts": parts, "inserted": count})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder}/{n:06d}")
    if not options.defer_graph and options.index_mode == "immediate":
        collection.optimize()
    return BulkResult(inserted, token, errors)
