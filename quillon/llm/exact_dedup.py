"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Misra-Gries counters name every digest that may hold more than ``support`` of all rows. The true counts of
these few candidates are then taken, and the winners of those that really are frequent (at most 1/support
rows) are broadcast, so that rows of huge groups find their winner without a shuffle. All other digests go
through an ordinary shuffle, in which no group is larger than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WHITE, cut, text_of

SUPPORT = 1 / 512


def normalized(text: Column) -> Column:
    """Text without the characters [\\x20\\x09-\\x0D]."""
    return F.translate(text, WHITE, "")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting white space; the row with the most code points stays, then
    the smallest id. Null text counts as empty, and all empty texts form one group. A null id loses every tie
    and is kept only in a group of null ids. Rows that repeat an id and its text are both ``kept``: they name
    the same document. An empty table gives an empty result. Other columns, whatever their names, play no part.
    """
    slim = cut(
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select(
            "doc_id", F.sha2(normalized(F.col("t")), 256).alias("text_sha256"), F.char_length("t").alias("n")
        )
    )
    least = slim.count() * support
    rank = F.struct(F.col("n"), (-F.col("doc_id")).alias("back"))
    best = (F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("best"))
    named = slim.freqItems(["text_sha256"], support).select(F.explode(F.col("text_sha256_freqItems")).alias("text_sha256"))
    # Both broadcasts hold at most 1/support digests, whatever the input.
    heavy = cut(
        slim.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(*best).filter(F.col("group_size") >= F.greatest(F.lit(2.0), F.lit(least)))
    )
    rest = slim.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    found = slim.join(F.broadcast(heavy), "text_sha256").unionByName(rest.join(rest.groupBy("text_sha256").agg(*best), "text_sha256"))
    keep = (-F.col("best.back")).alias("keep_id")
    return found.select("doc_id", keep, "group_size", "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _row_key(doc_id: Column, digest: Column) -> Column:
    return F.concat_ws(" ", digest, doc_id.cast("string"))  # a null id adds nothing


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row of docs, with all its columns, for each group: that with the most code points under the winner's id."""
    kept = duplicate_groups(docs, id_col, text_col, support).filter("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256")).alias("__key")).distinct()
    text = text_of(text_col)
    keyed = docs.select(F.struct("*").alias("__row"), F.char_length(text).alias("__n"), _row_key(F.col(id_col), F.sha2(normalized(text), 256)).alias("__key"))
    # the join leaves the rows dealt by key, so that choosing one doesn't shuffle them again
    return keyed.join(kept, "__key", "left_semi").groupBy("__key").agg(F.max_by("__row", "__n").alias("__row")).select("__row.*")
