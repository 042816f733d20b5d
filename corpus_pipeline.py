"""A corpus pipeline of five stages, each writing its rows and the next one reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import linededup, mixing, simhash, spm, toxicity
from tickloom.llm.common import swept
from tickloom.llm.queries import PIECES, table


# Each stage keeps null, empty and very long texts, repeated rows and extra columns as its operator says; an empty table gives one.


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from sf_dir's labels, doesn't reject. Of texts alike all or none go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; a text may end up empty."""
    return linededup.replaced(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; empty and null texts are one group."""
    return simhash.one_of_each(docs)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, those taken twice standing there twice; a source without words isn't in it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text for each row of the mix; none for null and empty texts."""
    return spm.encoded(docs, PIECES)


STAGES = [("toxicity", without_toxic), ("line dedup", without_passages), ("SimHash near-dedup", without_copies), ("mixing", weighted), ("SentencePiece", tokens)]
#: Toxicity and encoding have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage stores on its way goes once its rows are written; those stay, as each is the next
    one's input. No documents: no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with swept(spark) as outliving:
            docs = outliving(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
