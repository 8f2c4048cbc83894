"""From raw documents to token ids: five stages, each written as Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the
last return the columns of documents. Null texts and texts without a letter leave in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import read_table, scratch, staged
from brindle.llm.decontaminate import remove_contamination
from brindle.llm.langid import reject_unidentified
from brindle.llm.neardup import keep_one
from brindle.llm.quality import keep_quality
from brindle.llm.sentencepiece import default_model, encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return reject_unidentified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer accepts."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; n_chars follows the text."""
    return remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, which decode to the text again."""
    return encode_documents(docs, default_model())


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: No stage is expressible in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from all documents. A stage's table is deleted once that of the next one is written; the last one stays."""
    return _after(spark, sf_dir, len(STAGES))


def _after(spark: SparkSession, sf_dir: str, stages: int) -> DataFrame:
    if not stages:
        return read_table(spark, sf_dir, "documents")
    name, stage = STAGES[stages - 1]
    with scratch(spark):  # holds what the stage stages, and the table of the stage before
        docs = _after(spark, sf_dir, stages - 1)
        return staged(stage(spark, docs, sf_dir), name, keep=True)
