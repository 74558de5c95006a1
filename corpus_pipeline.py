"""The corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result
is written as Parquet and read again as the next stage's docs.

1. quality_rules   rows that fail the base rule or their group's adaptive thresholds go
2. line_dedup      lines that repeat or nearly repeat an earlier line go
3. simhash_dedup   of each group of near copies the smallest id stays
4. source_mix      the rest is mixed to the sources' target weights; a document drawn twice
                   gives two rows, one drawn in part gives a row with that part
5. packing         all texts become token pieces in sequences of at most 1024 tokens

Rows with null ids, null texts and equal rows are treated as the operators' docstrings say; an
empty table gives no pieces; further columns of documents pass through the first four stages.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lakebuild.llm import line_dedup, quality_rules, simhash_dedup, source_mix, vector_packing
from lakebuild.llm.queries import tokenizer_path
from lakebuild.session import scratch_path
from lakebuild.versions import discard


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_duplicate_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = vector_packing.pieces(docs, tokenizer_path(), with_ids=True)
    return vector_packing.pack(parts, docs.count())


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: SimHash components and seeded draws have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared checkpoint folder, each until the
    next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, done = scratch_path(spark, "pipeline", unique=True), None
    for name, stage in STAGES[:-1]:
        at = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if done:
            discard(spark, done)
        done = at
    return STAGES[-1][1](spark, docs, sf_dir)
