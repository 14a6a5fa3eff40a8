"""Packing of consecutive units into blocks of limited size.

A block starts where a unit no longer fits; where that is depends on all units before it,
in order. So the fold streams (ordinal, length) pairs, and nothing else, through one task
per group; groups (files, or any columns) are what runs in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_of(units: DataFrame, max_chars: int = 2048, group: Sequence[str] = ()) -> DataFrame:
    """ordinal and block, the ordinal of its block's first unit, by unit; per group in order of ordinal."""
    sized = units.select(*group, "ordinal", (F.length("source_text") + F.length("target_text")).cast("long").alias("n__"))
    keys = list(group) or ["g__"]
    if not group:
        sized = sized.withColumn("g__", F.lit(0))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, block = None, 0, None
        for b in batches:
            blocks = []
            for key, ordinal, n in zip(b[keys].itertuples(index=False, name=None), b["ordinal"].tolist(), b["n__"].tolist()):
                if key != now or used + n > max_chars:
                    now, used, block = key, 0, ordinal
                used += n
                blocks.append(block)
            yield pd.DataFrame({"ordinal": b["ordinal"], "block": blocks})

    ordered = sized.repartition(*keys).sortWithinPartitions(*keys, "ordinal")
    return ordered.mapInPandas(fold, "ordinal long, block long")


def pack(units: DataFrame, max_chars: int = 2048, group: Sequence[str] = ()) -> DataFrame:
    """Blocks: ordinal (their first unit's), its id and languages, and the texts joined by line ends.

    Without group the whole corpus is one sequence, streamed through one task as two numbers a
    unit; texts are joined by block, in parallel. With group=["file_id"] files run in parallel.
    """
    joined = units.join(block_of(units, max_chars, group), "ordinal")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "source_text", "target_text")))
    head = F.min_by(F.struct("tu_id", "source_lang", "target_lang"), "ordinal")
    blocks = joined.groupBy("block").agg(parts.alias("parts"), head.alias("head"))
    text = lambda c: F.array_join(F.col("parts")[c], "\n").alias(c)
    return blocks.select(F.col("block").alias("ordinal"), "head.tu_id", "head.source_lang", "head.target_lang", text("source_text"), text("target_text"))
