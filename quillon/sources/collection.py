"""Collections of vectors on Parquet: a folder per collection with a JSON sidecar, append-only segments and compaction.

A change is a new segment of rows (seq, deleted); reading takes the newest row of each id. Parquet's committed writes stand in for a
write-ahead log. The JSON sidecar and manifests go through Spark's writers, so any file system that Spark reaches can hold a catalog.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.distance import checked, known
from quillon.lineage import in_order

NAME = re.compile("[a-zA-Z0-9_-]{1,256}")
QUANTILE = 0.99
COMPACT_FROM = 4
MODES = ("vector_only", "auto_similarity", "hybrid")


@dataclass(frozen=True)
class Config:
    name: str
    dimension: int
    metric: str = "cosine"
    threshold: float | None = None
    max_vectors: int = 0
    data_type: str = "f32"
    quantization: str | None = None
    quantile: float = QUANTILE
    mode: str = "vector_only"


def config(name: str, dimension: int, metric: str = "", threshold: float = 0.0, quantile: float = 0.0, mode: str = "vector_only", **more) -> Config:
    """A checked configuration: a threshold of 0 or less is unset, a quantile of 0 or less is 0.99, a blank metric is cosine."""
    if not NAME.fullmatch(name) or name.startswith("_"):
        raise ValueError(f"not a collection name: {name!r}")
    if dimension <= 0:
        raise ValueError("the dimension must be positive")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return Config(name, dimension, known(metric or "cosine"), threshold if threshold > 0 else None, quantile=quantile if quantile > 0 else QUANTILE, mode=mode, **more)


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.folder}/{name}/config")
        return fs.exists(p)

    def create(self, settings: Config) -> Collection:
        if self.exists(settings.name):
            raise ValueError(f"{settings.name} exists")
        self._save(settings)
        return Collection(self, settings)

    def _save(self, settings: Config) -> None:
        self.spark.createDataFrame([(json.dumps(asdict(settings)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{settings.name}/config")

    def get(self, name: str) -> Collection:
        if not self.exists(name):
            raise KeyError(name)
        row = self.spark.read.text(f"{self.folder}/{name}/config").first()
        return Collection(self, Config(**json.loads(row["value"])))

    def list(self) -> list[str]:
        fs, p = self._fs(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and self.exists(s.getPath().getName())) if fs.exists(p) else []

    def delete(self, name: str) -> None:
        if not self.exists(name):
            raise KeyError(name)
        fs, p = self._fs(f"{self.folder}/{name}")
        fs.delete(p, True)


class Collection:
    def __init__(self, catalog: Catalog, settings: Config):
        self.catalog, self.spark, self.config = catalog, catalog.spark, settings
        self.folder = f"{catalog.folder}/{settings.name}"

    def _segments(self) -> list[str]:
        fs, p = self.catalog._fs(f"{self.folder}/segments")
        return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []

    def raw(self) -> DataFrame | None:
        """All rows of all segments, old versions and deletions included."""
        parts = self._segments()
        return self.spark.read.option("mergeSchema", "true").parquet(*parts) if parts else None

    def load(self) -> DataFrame:
        """(id, embedding, version, metadata columns...): the newest row of each id, without deleted ones."""
        rows = self.raw()
        if rows is None:
            return self.spark.createDataFrame([], "id long, embedding array<float>, version int")
        newest = Window.partitionBy("id").orderBy(F.desc("__seq"))
        return rows.withColumn("__rn", F.row_number().over(newest)).filter("__rn = 1 and not __deleted").drop("__rn", "__seq", "__deleted")

    def _append(self, rows: DataFrame, deleted: bool = False) -> None:
        seq = len(self._segments()) + self._compacted()
        out = rows.withColumn("__seq", F.lit(seq).cast("long")).withColumn("__deleted", F.lit(deleted))
        out.write.parquet(f"{self.folder}/segments/{seq:012d}-{uuid.uuid4().hex[:8]}")

    def _compacted(self) -> int:
        parts = self._segments()
        return int(parts[-1].rsplit("/", 1)[-1].split("-")[0]) + 1 - len(parts) if parts else 0

    def insert(self, rows: DataFrame) -> DataFrame:
        """Adds rows(id, embedding, ...) and gives (id) of all; id 0 or null takes the next free one. An id that is there is an error, as is a
        vector of another dimension or with NaN."""
        there = self.load().select("id")
        top = there.agg(F.max("id")).first()[0] or 0
        wanted = rows.filter("id > 0")
        clash = wanted.groupBy("id").count().filter("count > 1").select("id").union(wanted.select("id").join(there, "id", "left_semi")).first()
        if clash is not None:
            raise ValueError(f"id {clash['id']} exists")
        top = max(top, wanted.agg(F.max("id")).first()[0] or 0)
        free = rows.filter("coalesce(id, 0) = 0").drop("id")
        given = in_order(free, "id").withColumn("id", F.col("id") + top + 1)
        every = wanted.unionByName(given).withColumn("embedding", checked(F.col("embedding").cast("array<float>"), self.config.dimension)).withColumn("version", F.lit(1))
        seq = len(self._segments()) + self._compacted()
        self._append(every)
        return self.spark.read.parquet(*[p for p in self._segments() if p.rsplit("/", 1)[-1].startswith(f"{seq:012d}")]).select("id")

    def get(self, id: int):
        """One row, None if it isn't there."""
        return self.load().filter(F.col("id") == id).first()

    def update(self, rows: DataFrame) -> None:
        """rows(id[, embedding][, metadata...]): a vector, metadata or both. Metadata, where given, replaces the whole bag; version goes up."""
        old = self.load()
        meta = [c for c in rows.columns if c not in ("id", "embedding")]
        if "embedding" not in rows.columns and not meta:
            raise ValueError("nothing to update")
        missing = rows.select("id").join(old.select("id"), "id", "left_anti").first()
        if missing is not None:
            raise KeyError(missing["id"])
        joined = old.select("id", "version", F.col("embedding").alias("__e"), *([c for c in old.columns if c not in ("id", "version", "embedding")] if not meta else [])).join(rows, "id")
        vector = F.coalesce("embedding", "__e") if "embedding" in rows.columns else F.col("__e")
        out = joined.withColumn("embedding", checked(vector.cast("array<float>"), self.config.dimension)).withColumn("version", F.col("version") + 1).drop("__e")
        self._append(out)

    def delete(self, ids: Sequence[int]) -> None:
        """Edges of a graph that touch these ids stay."""
        rows = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        missing = rows.join(self.load().select("id"), "id", "left_anti").first()
        if missing is not None:
            raise KeyError(missing["id"])
        self._append(rows, deleted=True)

    def compact(self, least: int = COMPACT_FROM) -> dict[str, int]:
        """Merges segments, if there are so many, into one: {merged, written, removed}."""
        parts = self._segments()
        if len(parts) < least:
            return {"merged": 0, "written": 0, "removed": 0}
        rows = self.raw().count()
        seq = int(parts[-1].rsplit("/", 1)[-1].split("-")[0]) + 1
        out = self.load().withColumn("__seq", F.lit(seq).cast("long")).withColumn("__deleted", F.lit(False))
        target = f"{self.folder}/segments/{seq:012d}-{uuid.uuid4().hex[:8]}"
        out.write.parquet(target)
        for p in parts:
            fs, path = self.catalog._fs(p)
            fs.delete(path, True)
        written = self.spark.read.parquet(target).count()
        return {"merged": len(parts), "written": written, "removed": rows - written}

    def status(self) -> dict[str, object]:
        return {"name": self.config.name, "count": self.load().count(), "segments": len(self._segments()), "status": "ready" if self._optimized() else "pending_optimization"}

    def _mark(self) -> str:
        return json.dumps([p.rsplit("/", 1)[-1] for p in self._segments()])

    def _optimized(self) -> bool:
        """Whether what optimize() makes covers all segments; a collection that needs nothing made always is."""
        if self.config.quantization != "sq8" and self.config.mode == "vector_only" or not self._segments():
            return True
        fs, p = self.catalog._fs(f"{self.folder}/optimized")
        return fs.exists(p) and self.spark.read.text(f"{self.folder}/optimized").first()["value"] == self._mark()

    def optimize(self) -> str:
        """Writes scalar codes and the similarity graph anew, as the mode asks; already_optimized if nothing came since."""
        from quillon.operators import quant, simgraph

        mark = self._mark()
        fs, p = self.catalog._fs(f"{self.folder}/optimized")
        if fs.exists(p) and self.spark.read.text(f"{self.folder}/optimized").first()["value"] == mark:
            return "already_optimized"
        rows = self.load()
        if self.config.quantization == "sq8":
            codes = quant.train_scalar(rows, self.config.quantile)
            quant.scalar_encode(rows, codes).write.mode("overwrite").parquet(f"{self.folder}/codes")
        if self.config.mode != "vector_only":
            simgraph.build(rows, self.config.threshold or simgraph.THRESHOLD, self.config.metric).write.mode("overwrite").parquet(f"{self.folder}/sim_edges")
        self.spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/optimized")
        return "completed"

    def set_threshold(self, threshold: float, vector_id: int = 0) -> Collection:
        """Vector 0 stands for the collection, whose similarity graph is then to be made again; of another one it is kept as its own threshold, and
        edges that are there stay."""
        if not vector_id:
            out = Collection(self.catalog, replace(self.config, threshold=threshold))
            self.catalog._save(out.config)
            fs, p = self.catalog._fs(f"{self.folder}/optimized")
            fs.delete(p, True)
            return out
        if self.get(vector_id) is None:
            raise KeyError(vector_id)
        row = self.spark.createDataFrame([(vector_id, float(threshold), time.time_ns())], "id long, threshold_override double, at long")
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/thresholds")
        return self

    def thresholds(self) -> DataFrame:
        """(id, threshold_override): the newest of each vector that has one of its own."""
        fs, p = self.catalog._fs(f"{self.folder}/thresholds")
        if not fs.exists(p):
            return self.spark.createDataFrame([], "id long, threshold_override double")
        return self.spark.read.parquet(f"{self.folder}/thresholds").groupBy("id").agg(F.max_by("threshold_override", "at").alias("threshold_override"))

    def backup(self, folder: str) -> DataFrame:
        """A copy of the rows and a manifest (id, sha256) of them."""
        rows = self.load()
        rows.write.parquet(f"{folder}/rows")
        manifest(self.spark.read.parquet(f"{folder}/rows")).write.parquet(f"{folder}/manifest")
        return self.spark.read.parquet(f"{folder}/manifest")

    def restore(self, folder: str) -> int:
        """Takes a backup's rows into an empty collection; a row that differs from the manifest is an error."""
        if self._segments():
            raise ValueError("only an empty collection can be restored")
        rows = self.spark.read.parquet(f"{folder}/rows")
        wrong = manifest(rows).exceptAll(self.spark.read.parquet(f"{folder}/manifest")).first()
        if wrong is not None:
            raise ValueError(f"row {wrong['id']} differs from the manifest")
        self._append(rows)
        return rows.count()


def manifest(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("sha256"))


def read_npy(spark: SparkSession, path: str, ids_path: str | None = None, chunk: int = 50_000) -> DataFrame:
    """(id, embedding) of a two-dimensional .npy file of little-endian 32-bit floats, rows in C order, and of a one-dimensional .npy of 64-bit ids; ids start at 1 without it."""
    x = np.load(_safe(path), mmap_mode="r")
    if x.ndim != 2 or x.dtype != np.dtype("<f4") or not x.flags.c_contiguous:
        raise ValueError("two dimensions of little-endian 32-bit floats in C order are needed")
    return _rows(spark, x, ids_path, chunk)


def read_f32(spark: SparkSession, path: str, dimension: int, ids_path: str | None = None, chunk: int = 50_000) -> DataFrame:
    """The same of a flat file of 32-bit floats, whose size must be a multiple of the dimension."""
    flat = np.memmap(_safe(path), "<f4", "r")
    if dimension <= 0 or len(flat) % dimension:
        raise ValueError("the file's size is no multiple of the dimension")
    return _rows(spark, flat.reshape(-1, dimension), ids_path, chunk)


#: Folders that files are read from; any, if there is none.
ALLOWED: list[str] = []


def _safe(path: str) -> str:
    if not path.startswith("/") or "\0" in path or {".", ".."} & set(path.split("/")):
        raise ValueError(f"not an absolute, plain path: {path!r}")
    if ALLOWED and not any(path.startswith(f"{a.rstrip('/')}/") for a in ALLOWED):
        raise PermissionError(f"not in an allowed folder: {path!r}")
    return path


def _rows(spark: SparkSession, x: np.ndarray, ids_path: str | None, chunk: int) -> DataFrame:
    import pyarrow as pa

    ids = np.arange(1, len(x) + 1, dtype=np.int64)
    if ids_path:
        ids = np.load(_safe(ids_path), mmap_mode="r")
        if ids.ndim != 1 or ids.dtype != np.dtype("<i8") or len(ids) != len(x):
            raise ValueError("one dimension of as many 64-bit ids is needed")
    kind = pa.list_(pa.float32())
    parts = []
    for at in range(0, max(len(x), 1), chunk):
        block = np.ascontiguousarray(x[at : at + chunk])
        offsets = pa.array(np.arange(0, block.size + 1, max(x.shape[1], 1)), pa.int32())
        parts.append(pa.table({"id": pa.array(ids[at : at + chunk]), "embedding": pa.ListArray.from_arrays(offsets, pa.array(block.reshape(-1))).cast(kind)}))
    return spark.createDataFrame(pa.concat_tables(parts))


def np_insert(collection: Collection, x: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    ids = np.zeros(len(x), np.int64) if ids is None else ids
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    return collection.insert(collection.spark.createDataFrame(rows, "id long, embedding array<float>"))


def np_search(collection: Collection, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) as arrays."""
    from quillon.operators.knn import search

    rows = search(collection.load(), query.tolist(), k, collection.config.metric).toPandas()
    return rows["id"].to_numpy(), rows["score"].to_numpy()
