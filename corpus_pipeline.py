"""A cleaning pipeline over `documents`: quality, near duplicates, benchmark leaks, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents, any extra ones included.

In all stages a null text counts as empty and is no reason to fail, very long texts are treated whole, rows may be
repeated, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import decontam, mixing, neardup, quality, secrets
from quirefold.llm.common import discard_others, materialise, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal classifier, fitted on the labels, rejects; without labels all stay.

    Documents without words are judged by their length, like any other; repeated rows share their fate.
    """
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, one of rows equal in id and text.

    Documents without words are copies of none and stay; an id of null stands behind all others.
    """
    return neardup.deduplicate(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget, all of repeated rows.

    Null and empty texts hold none and stay; without items all stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by the names of their rules; n_chars follows.  Rows without any, null texts among
    them, pass as they are; repeated rows are masked alike."""
    return secrets.redact(docs, count_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the mix: a row for each document that it takes words from; none has null or empty text.
    Repeated rows are documents of their own, a null source is a source."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", without_leaks),
    ("secrets", without_secrets),
    ("mix", mixed),
]

#: A fitted classifier and a graph's components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on its way is deleted once its result stands."""
    docs = table(spark, sf_dir, "documents")
    before = written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            discard_others(before, docs)
    return docs
