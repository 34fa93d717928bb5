"""A corpus from raw documents to tokens: each stage works on all that the one before has kept.

The rules of every stage but the last: nulls may be in any column, and a null text counts as empty; texts are read whole, however
long; repeated rows are rows of their own unless the stage says otherwise; an empty table gives an empty table; columns keep
their names and order, whatever they are called. Rows without doc_id take part like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabframe.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from tabframe.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; labels come from their own table, and without them all documents stay. Texts that
    are null, empty or without words have nothing to be judged by and stay unless the model takes that for toxic; repeated rows
    go or stay together, as the score follows from the text alone."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays: the one with the most code points, then the smallest doc_id. Null, empty
    and blank texts are equal, so one of them stays; rows that repeat the id and the text that stay are kept."""
    return exact_dedup.unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar shingles the one with the smallest doc_id stays, once if its row is repeated.
    Texts without words are similar to nothing and stay, as do rows without doc_id."""
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight wants them; a null source is a source, the last one. A text without
    words has nothing to take and goes. A document is there three times at most, the last time perhaps with some of its
    words; the choice follows from ids, so reruns agree."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, and that they decode to its text, as digests; a row for each row, a null text is empty."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources), ("byte-pair encoding", tokens),
]

#: SQL can express neither the network nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
