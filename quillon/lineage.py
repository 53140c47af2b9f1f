"""Cutting a plan's lineage through reliable files in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver's Python ends."""
    folder = f"{_shared(spark).rstrip('/')}/quillon-{uuid.uuid4().hex}"

    def clear() -> None:
        with contextlib.suppress(Exception):  # the session may have ended with its file system
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    atexit.register(clear)
    return folder


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in spark.checkpoint.dir; a local session where none is set takes a temporary folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def in_order(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with its rows numbered from 0 in an order, or as they come, kept in spark.checkpoint.dir.

    The sort is by ranges, over all tasks; each task's rows are counted and numbered from where the tasks before it end.
    """
    tagged = cut((df.orderBy(*order) if order else df).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    before = tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__b"))
    within = F.shiftrightunsigned(F.shiftleft(F.col("__m"), 31), 31)
    return tagged.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + within).drop("__p", "__m", "__b")
