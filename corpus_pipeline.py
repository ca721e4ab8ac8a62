"""A corpus pipeline of five stages over ``documents``; each calls one operator on all that its predecessor kept.

``run`` writes each stage's rows as Parquet in the shared folder and reads them again, so rows are numbered by file and
place. No empty document reaches packing: the quality stage rejects those that come empty, and line dedup those that it
has emptied.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm import store
from tilequarry.llm.jaccard import keep_first
from tilequarry.llm.leaks import decontaminate
from tilequarry.llm.lines import without_later_lines
from tilequarry.llm.packing import pack
from tilequarry.llm.quality import keep_good

TOKENIZER = "byte_bpe_50k.json"
KEEP_WORDS = 400_000  # executors that have run the other stages have less memory to spare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; n_chars follows. A document of which no word is left goes."""
    return without_later_lines(docs).where(F.col("text").rlike("[^ \\t-\\r]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 ids."""
    return pack(docs, public_tokenizers.path(TOKENIZER), with_ids=False, keep_words=KEEP_WORDS)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None  # similarity joins, tokenization and packing have no SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name, rebalance=False)
    return STAGES[-1][1](spark, docs, sf_dir)
