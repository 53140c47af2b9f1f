"""Connected components by alternating star contraction; nothing is collected to the driver but two counts a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut

ROUNDS = 60
#: A graph of up to so many edges is worked on by one task, which spares a small graph the files of many shuffles.
FEW = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges(a, b); comp is the smallest node of its component.

    Each round hangs every node's larger neighbours on its smallest one, then every node and its smaller neighbours on
    the smallest of them, until only stars are left. Rounds grow with the logarithm of the longest path.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    together = (lambda df: df.coalesce(1)) if edges.count() <= FEW else (lambda df: df)
    for _ in range(ROUNDS):
        # all stars: no node hangs on two others, and none on which others hang hangs itself
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs")).union(edges.select("v", F.lit(0)))
        tied = together(ends).groupBy("n").agg(F.sum("hangs").alias("up"), F.min("hangs").alias("down")).filter("up > 1 or up = 1 and down = 0")
        if tied.isEmpty():
            break
        both = together(edges.union(edges.select("v", "u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())


def joined_components(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of comp(node, comp) after some more edges(a, b), from the graph of components that these edges join."""
    of = edges
    for side in ("a", "b"):
        of = of.join(comp.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp")), side, "left")
    between = of.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    over = cut(components(between).select(F.col("node").alias("comp"), F.col("comp").alias("to")))
    known = comp.join(over, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp.select("node"), "node", "left_anti")
    return cut(known.unionByName(ends.join(over.withColumnRenamed("comp", "node"), "node").select("node", F.col("to").alias("comp"))))
