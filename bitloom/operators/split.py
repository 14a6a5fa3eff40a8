"""Splits of exact sizes, at random by a seed, in all or by language pair.

A unit's place in the shuffle is the rank of md5(seed:ordinal:side). The global rank needs
no single sort task: ranks are counted by the leading bits of the hash, put together by a
prefix sum over those few counts, and completed within each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
NAMES = ("train", "validation", "test")


def split_sizes(total: int, train: float, validation: float, test: float) -> tuple[int, int, int]:
    """Whole sizes that add up: the largest remainders round up, earlier splits first among equals."""
    shares = [train, validation, test]
    if total < 0 or not all(math.isfinite(r) and r >= 0 for r in shares) or abs(sum(shares) - 1) > 1e-9:
        raise ValueError("ratios must be finite, not negative, and add up to 1")
    exact = [total * r for r in shares]
    sizes = [math.floor(x) for x in exact]
    for k in sorted(range(3), key=lambda k: sizes[k] - exact[k])[: total - sum(sizes)]:
        sizes[k] += 1
    return tuple(sizes)


def _bounds(n: Column, ratios: tuple[float, float, float]) -> tuple[Column, Column]:
    """Ends of train and of validation for n rows, by the rule of split_sizes."""
    n = n.cast("double")
    exact = [n * F.lit(r) for r in ratios]
    down = [F.floor(x) for x in exact]
    part = [x - d for x, d in zip(exact, down)]
    left = n.cast("long") - down[0] - down[1] - down[2]

    def size(k: int) -> Column:
        before = sum(((part[j] > part[k]) | ((part[j] == part[k]) & F.lit(j < k))).cast("long") for j in range(3) if j != k)
        return down[k] + (before < left).cast("long")

    return size(0), size(0) + size(1)


def split(rows: DataFrame, ratios: tuple[float, float, float] = (0.9, 0.05, 0.05), seed: int = SEED, strata: list[str] | None = None, bits: int = 12) -> DataFrame:
    """rows, which have ordinal and may have side, with a column split. strata: columns of which each combination is split by itself; null is a value."""
    split_sizes(0, *ratios)
    side = [F.col("side").cast("string")] if "side" in rows.columns else []
    keyed = rows.withColumn("h__", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ordinal").cast("string"), *side)))
    keyed = keyed.withColumn("p__", F.substring("h__", 1, bits // 4)).withColumn("s__", F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in strata])) if strata else F.lit(""))
    counts = keyed.groupBy("s__", "p__").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("s__").orderBy("p__")
    counts = counts.select("s__", "p__", (F.sum("n").over(by) - F.col("n")).alias("base__"), F.sum("n").over(Window.partitionBy("s__")).alias("n__"))
    rank = F.row_number().over(Window.partitionBy("s__", "p__").orderBy("h__", "ordinal"))
    ranked = keyed.withColumn("r__", rank).join(counts, ["s__", "p__"])
    first, second = _bounds(F.col("n__"), ratios)
    place = F.col("base__") + F.col("r__")
    named = F.when(place <= first, NAMES[0]).when(place <= second, NAMES[1]).otherwise(NAMES[2])
    return ranked.select(*rows.columns, named.alias("split"))


def split_counts(rows: DataFrame) -> dict[str, int]:
    found = {x.split: x.n for x in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"total": sum(found.values()), **{k: found.get(k, 0) for k in NAMES}}
