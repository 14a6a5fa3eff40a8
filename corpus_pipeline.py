"""The corpus pipeline: each stage works on all that the one before it kept.

1. quality rules: documents that the rules or the line labels reject go.
2. SimHash near-dedup: the smallest doc_id of each group stays.
3. substring dedup: words of repeated passages go; of a document that loses some the rest,
   joined by one space, is the text, and a document that loses all goes.
4. benchmark decontamination: documents of which benchmark windows cover a twentieth go, and
   all others lose the words that such windows cover: none occurs in what stays.
5. packing: a row for each piece of a document in a sequence.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import op01_simhash, op02_quality, op04_pack, op09_decontaminate, op10_substring
from bitloom.llm._spark import drop, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op02_quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_simhash.dedup(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_substring.dedup(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_pack.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Learned and iterative stages have no SQL; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.lower().replace(' ', '-')}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
