"""A corpus from documents: good ones, each text once, one of near-duplicates, mixed by source, as token ids.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import encoded
from quillon.llm.common import Scratch, table
from quillon.llm.exact_dedup import deduplicate
from quillon.llm.jaccard_join import one_of_each
from quillon.llm.mixing import mix
from quillon.llm.quality import accepted, train
from quillon.llm.queries import tokenizer_text

#: The mixture takes as many tokens as its input has, at most twice from any document.
MIX = {"weights": {"lang": {"en": 3, "de": 2, "fr": 2, "es": 2}}, "percent": 100, "max_epochs": 2, "seed": 29}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts. Null and empty texts are scored like others; null ids are kept; labels may be empty."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then the smallest id; all null and empty texts are one group."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, that of the smallest id; texts without words and rows of null ids stay."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that each source's budget takes, repeated as often as it takes them; null languages and sources are the empty name."""
    return mix(docs, **MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row; a null text is empty and has none."""
    return encoded(docs, tokenizer_text("word_bpe_49k.json"), full=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: The classifier is trained, which SQL can't express; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.kept(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
