"""The corpus pipeline: quality, exact copies, near copies, mixing, packing. Each stage takes (spark, docs, sf_dir).

Defined results of the stages, besides those of their operators: a stage returns rows of docs, unchanged, with all their columns whatever their
names; a null text is empty, a null source is a source of its own, a null doc_id loses ties; repeated rows are judged alike by quality, one of
them stays after exact and near copies, and mixing and packing take each as a document; an empty table gives an empty table. The quality stage wants the
column n_chars, which documents have; null counts as 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, mixing, ngram_join, packing, quality
from quire.llm.common import delete, own_cuts, read, shared_dir
from quire.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those docs that labels covers, doesn't reject."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.dedup(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("pack", pack_stage)]
#: No SQL: the classifier and the tokenizer have none. Tested against a plain rendering instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next. What a stage has read and its
    checkpoints are removed once its own rows are written.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with own_cuts(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    return docs
