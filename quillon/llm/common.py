"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts strip: space and \x09-\x0D.
WHITE = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return context.getCheckpointDir()


class Scratch:
    """Tables written to a folder of their own in the shared one. Those not dropped before go when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and read again, which cuts its lineage."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no result will read again."""
        for name in names:
            self._delete(f"{self.folder}/{name}")

    def _delete(self, path: str) -> None:
        java = self.spark._jvm
        at = java.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended with its folders' file system
            self._delete(self.folder)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut through reliable files, which outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: At most so many keys are broadcast, whatever the input; a key of fewer rows than LIGHT isn't worth it.
HEAVY, LIGHT = 512, 2000


def joined(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has one short row for each of its keys; how is inner or left.

    Keys of more than 1 / HEAVY of all rows, of which there can't be more than HEAVY, are counted first (in counted, if that is cheaper to
    read) and table's rows of them are broadcast, so that none of them meets in one task; the rest is shuffled.
    """
    counted = rows if counted is None else counted
    total = counted.count()
    if total <= LIGHT and how == "inner":
        return table.join(F.broadcast(rows), list(keys))  # no more than LIGHT rows, all different or fewer than counted
    known = F.lit(True)
    for key in keys:
        known &= F.col(key).isNotNull()
    top = counted.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LIGHT).orderBy(F.desc("__n")).limit(HEAVY).collect() if total > LIGHT else []
    least = total // HEAVY
    heavy = [r[: len(keys)] for r in top if r["__n"] > least]
    if not heavy:
        return rows.join(table.hint("merge"), list(keys), how)
    named = F.broadcast(rows.sparkSession.createDataFrame(heavy, rows.select(*keys).schema))
    hot = F.broadcast(table.join(named, list(keys), "left_semi"))
    apart = rows.join(named, list(keys), "left_anti").join(table.hint("merge"), list(keys), how)
    return rows.join(named, list(keys), "left_semi").join(hot, list(keys), how).unionByName(apart)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: What operators keep in a process from one task to the next, by operator: the cache and what empties it.
_CACHES: list[tuple[str, Sized, Callable[[], None]]] = []


def keeps(operator: str, cache: Sized, empty: Callable[[], None]) -> None:
    _CACHES.append((operator, cache, empty))


def release(operator: str | None = None) -> None:
    """Empties the caches of all operators but this one, and gives their memory back.

    Spark's Python workers serve one stage after the other, so what a former operator has cached would add to what this one takes.
    """
    held = [empty for name, cache, empty in _CACHES if name != operator and len(cache)]
    for empty in held:
        empty()
    if held:
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have up to that many bytes, or one row."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        held = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, held + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
