"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with
the columns of documents. run() applies them to the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmill.llm import classifier, line_dedup, minhash, mixing, packing
from starmill.llm.common import forget, read, settled

#: SQL has no discriminant, patience diff, dart signatures or best-fit search; tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    return classifier.accepted(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that an earlier document holds; a document that loses all its words goes."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return minhash.first_of_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by target weights takes it."""
    return mixing.mixed_rows(docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words without two pieces of one source or text."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mixing", mixture), ("best-fit packing", bins)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. What a stage has kept on its way goes when its result is written, and that when the next one's is; the last stage's tables stay, as the result is read from them."""
    docs, last = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{k + 1}")
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
