"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The tree is domain > language > source. Leaf supplies are summed upwards; the token budget then flows down.
At each parent it is dealt to the children in proportion to their weights, and what a child's whole subtree
cannot use goes to its siblings. As a child is asked for no more than its subtree holds, a shortage reaches
an ancestor only when the siblings cannot take it. Each leaf spends its budget on whole epochs and then on the
token-prefix of one more epoch, in that epoch's seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, cut, text_of

LEVELS = ("domain", "lang", "source")
#: Hex digits of the epoch order that bin a leaf's documents; only the bin that the budget ends in is sorted.
BIN_DIGITS = 3


def source_domain(groups: int = 4) -> Column:
    """A domain from the number that ends a source's name: dom0, dom1, ...; none without a number."""
    number = F.regexp_extract(F.col("source"), "([0-9]{1,9})$", 1)
    return F.when(number == "", "none").otherwise(F.concat(F.lit("dom"), (number.cast("long") % groups).cast("string")))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, value in (weights.get(level) or {}).items():
        out = F.when(F.col(level) == name, int(value)).otherwise(out)
    return F.greatest(out, F.lit(0)).cast("long")


def _deal(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Adds alloc: each parent's budget dealt to its children by weight, none beyond its cap."""
    every = Window.partitionBy(*(parents or [F.lit(0)]))
    order = every.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0)), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0)))
        .withColumn("c_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", (F.col("cap") * F.col("w_rest") <= F.col("weight") * (F.col("budget") - F.col("c_before"))).cast("int"))
        .withColumn("full", F.min("full").over(upto))
        .withColumn("c_full", F.sum(F.when(F.col("full") == 1, F.col("cap")).otherwise(0)).over(every))
        .withColumn("w_open", F.sum(F.when(F.col("full") == 0, F.col("weight")).otherwise(0)).over(every))
    )
    share = F.expr("CASE WHEN full = 1 THEN cap ELSE (weight * (budget - c_full)) div w_open END")
    return ranked.select(*parents, level, share.cast("long").alias("alloc"))


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, supply) with each leaf's budget, for percent of all tokens.

    Weights are whole numbers; names without one weigh 1, and weight 0 gets nothing. Shares are rounded down,
    so each node may leave less than one token per child. Tokens times weight must stay below 2**63.
    """
    caps = leaves.withColumn("cap", F.col("supply") * max_epochs)
    total = leaves.agg((F.coalesce(F.sum("supply"), F.lit(0)) * percent / 100).cast("long").alias("budget"))
    top: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = caps.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        # total has one row
        nodes = nodes.crossJoin(F.broadcast(total)) if top is None else nodes.join(top.withColumnRenamed("alloc", "budget"), parents)
        top = _deal(nodes, parents, level)
    return leaves.join(top.withColumnRenamed("alloc", "budget"), list(LEVELS))


def mixture(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    percent: int,
    max_epochs: int,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Column | None = None,
) -> DataFrame:
    """One row per input row: doc_id, domain, lang, source, n_tokens, leaf_supply, leaf_budget, copies.

    copies is how often the document is taken: once for each whole epoch of its leaf, and once more if it is in
    the token-prefix of the last epoch, which stops before the budget is exceeded. Epoch e is ordered by
    md5(seed/e/doc_id), then doc_id. Tokens are the runs of characters outside [\\x20\\x09-\\x0D]. Null text is
    empty and has no tokens; a null language or source is the empty name; a leaf without tokens has budget 0 and
    its documents are taken 0 times beyond the prefix, into which a text without tokens always fits once its turn
    comes. Rows with the same id are counted as separate documents. An empty table gives an empty result.
    """
    dealt = _dealt(docs, weights, percent, max_epochs, seed, id_col, text_col, domain)
    return dealt.select("doc_id", *LEVELS, "n_tokens", F.col("supply").alias("leaf_supply"), F.col("budget").alias("leaf_budget"), "copies")


def _dealt(docs: DataFrame, weights, percent, max_epochs, seed, id_col, text_col, domain, *more: Column) -> DataFrame:
    """What mixture returns, with supply, budget and the columns ``more`` of each row."""
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("n_tokens"),
        *more,
    )
    slim = cut(slim.withColumn("domain", source_domain() if domain is None else domain))
    leaves = cut(leaf_budgets(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), weights, percent, max_epochs))
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = (
        slim.join(leaves, list(LEVELS))
        .withColumn("whole", F.expr("CASE WHEN supply > 0 THEN budget div supply ELSE 0 END"))
        .withColumn("left", F.col("budget") - F.col("whole") * F.col("supply"))
        .withColumn("at", key)
        .withColumn("bin", F.substring("at", 1, BIN_DIGITS))
    )
    bins = dealt.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_before", F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)))
    dealt = dealt.join(bins, [*LEVELS, "bin"])
    edge = (F.col("bin_before") <= F.col("left")) & (F.col("bin_before") + F.col("bin_tokens") > F.col("left"))
    order = Window.partitionBy(*LEVELS, "bin").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.filter(edge).withColumn("more", (F.col("bin_before") + F.sum("n_tokens").over(order) <= F.col("left")).cast("long"))
    apart = dealt.filter(~edge).withColumn("more", (F.col("bin_before") + F.col("bin_tokens") <= F.col("left")).cast("long"))
    return within.unionByName(apart).withColumn("copies", F.col("whole") + F.col("more"))


def _row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id, language, source and text."""
    return F.md5(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, "lang", "source", text_col))))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int, seed: int = 0) -> DataFrame:
    """The rows of docs, each repeated as often as mixture takes it, with the columns of docs.

    Rows that share an id are documents of their own; of rows that agree in id, language, source and text each gets one row's copies.
    """
    numbered = Window.partitionBy("__key")
    taken = _dealt(docs, weights, percent, max_epochs, seed, "doc_id", "text", None, _row_key("doc_id", "text").alias("__key"))
    taken = taken.select("__key", F.col("copies").alias("__copies")).withColumn("__nth", F.row_number().over(numbered.orderBy(F.desc("__copies"))))
    rows = docs.select(F.struct("*").alias("__row"), _row_key("doc_id", "text").alias("__key")).withColumn("__nth", F.row_number().over(numbered.orderBy(F.lit(0))))
    joined = rows.join(taken.filter("__copies > 0"), ["__key", "__nth"])
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
