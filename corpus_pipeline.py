"""A training corpus from ``documents``: filter, drop common lines, drop near copies, mix, pack.

Each stage takes what its predecessor kept, written as Parquet and read again, so a lost executor costs a stage at most.
All stages but the last return the columns they were given; the last returns the pieces of the packed sequences.

Mixing runs with rates of at most 1 and mild targets: no document is repeated, and the sources that have more tokens
than their share are thinned by a hash of the row.

Nulls and odd input: each stage's module says what it does with them; a table without rows runs through and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayflow.llm import lines, minhash, mixing, packing, rules
from assayflow.llm.common import Written

MIX_ALPHA, MOST_RATE = 0.9, 1.0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_common_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, alpha=MIX_ALPHA, most=MOST_RATE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Mixing fits rates by iteration and packing needs a tokenizer, so no SQL gives the last stage's rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Written(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return docs
