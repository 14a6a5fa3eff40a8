"""The queries of this package: one per operator, over its whole table, and what SQL can express of another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_simhash, op02_quality, op03_toxicity, op04_pack, op05_shard, op06_warc, op07_token_counts, op08_extract, op09_decontaminate, op10_substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op01_simhash.query,
    "op2_quality_rules": op02_quality.query,
    "op3_toxicity": op03_toxicity.query,
    "op4_packing": op04_pack.query,
    "op5_sharding": op05_shard.query,
    "op6_warc": op06_warc.query,
    "op7_token_counts": op07_token_counts.query,
    "op8_html_extraction": op08_extract.query,
    "op9_benchmark_decontamination": op09_decontaminate.query,
    "op10_substring_dedup": op10_substring.query,
    "quality_counts": op02_quality.counts,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op6_warc": op06_warc.SQL,
    "op9_benchmark_decontamination": op09_decontaminate.SQL,
    "op10_substring_dedup": op10_substring.SQL,
    "quality_counts": op02_quality.SQL_COUNTS,
}
