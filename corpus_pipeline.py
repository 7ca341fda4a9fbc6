"""From raw documents to packed sequences: five stages, each written before the next reads it.

quality: documents that the classifier rejects go; line_dedup: repeated lines stay only in
the document with the smallest id; near_dedup: one document of each near-duplicate group
stays; decontaminate: documents with a benchmark item in them go; pack: what is left
becomes token sequences. Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import decontaminate, line_dedup, packing, quality, simhash
from passagemill.llm.common import table
from passagemill.session import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, within=2)  # op7's links, and those of the whole sets


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

ORACLE_SQL = None  # the classifier and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
