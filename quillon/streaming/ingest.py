"""Streaming ingest into a collection: batches are idempotent, a bad row is an error of its own, and a checkpoint resumes a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.collection import Collection


def split_bad(rows: DataFrame, existing: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(good rows, (id, error)): empty vectors, other dimensions, NaN or infinities, ids that are there or come twice (the first stays)."""
    bad_number = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    tagged = rows.withColumn("__k", F.monotonically_increasing_id())
    first = tagged.filter("id > 0").groupBy("id").agg(F.min("__k").alias("__first"))
    joined = tagged.join(first, "id", "left").join(existing.select("id", F.lit(True).alias("__there")), "id", "left")
    error = (
        F.when(F.col("embedding").isNull() | (F.size("embedding") == 0), "an empty vector")
        .when(F.size("embedding") != dimension, "a vector of another dimension")
        .when(bad_number, "a vector with NaN or an infinity")
        .when(F.col("__there"), "the id exists")
        .when((F.col("id") > 0) & (F.col("__k") != F.col("__first")), "the id comes twice")
    )
    judged = joined.withColumn("__error", error)
    return judged.filter("__error is null").select(*rows.columns), judged.filter("__error is not null").select("id", F.col("__error").alias("error"))


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, on_errors: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a query that takes what is there and stops; started again with its checkpoint it goes on where it was.

    A batch that is repeated after a failure finds its ids in place and adds nothing twice: rows need ids of their own.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_bad(batch, collection.load(), collection.config.dimension)
        if on_errors is not None:
            on_errors(bad, number)
        if not good.isEmpty():
            collection.insert(good)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts per tumbling window and key of a stream, with rows later than late dropped."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count(F.lit(1)).alias("n"))
