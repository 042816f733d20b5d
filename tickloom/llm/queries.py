"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, langid, linededup, media, mixing, neighbours, periodic, quality, simhash, spm, tokencount, toxicity, warc

#: The public vocabularies that the queries hand to their operators, and the pattern published with the rank files.
PIECES, RANKS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))
PRETOKENS = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_documents(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _of_documents(simhash.near_duplicates),
    "op2_warc": op2_warc,
    "op3_media": _of_documents(media.columns),
    "op4_quality": _of_documents(quality.assess),
    "op5_mixing": _of_documents(mixing.mix),
    "op6_linededup": _of_documents(linededup.report),
    "op7_toxicity": op7_toxicity,
    "op8_tokencount": _of_documents(lambda docs: tokencount.counted(docs, RANKS, PRETOKENS)),
    "op9_langid": _of_documents(langid.identify),
    "op10_sentencepiece": _of_documents(lambda docs: spm.encoded(docs, PIECES)),
    "op11_periodic": _of_documents(periodic.report),
    "op12_collocations": _of_documents(collocations.collocations),
    "op13_neighbours": lambda spark, sf_dir: neighbours.near_duplicates(table(spark, sf_dir, "embeddings")),
}
SQL = {"op2_warc": warc.WARC_SQL, "op4_quality": quality.RULES_SQL, "op5_mixing": mixing.MIX_SQL, "op6_linededup": linededup.LINES_SQL, "op12_collocations": collocations.SQL, "op13_neighbours": neighbours.SQL}
