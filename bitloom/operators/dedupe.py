"""Exact and fuzzy deduplication; the earliest unit by ordinal stays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import drop, written
from . import near

THRESHOLD = 0.85


def normalized(c: str | Column, case_sensitive: bool = True) -> Column:
    c = T.strip(T.collapse(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return c if case_sensitive else F.lower(c)


def key_columns(case_sensitive: bool = True) -> dict[str, Column]:
    """Languages as they are, texts normalised."""
    lang = lambda c: F.coalesce(F.col(c), F.lit(""))
    return {"k_source_lang": lang("source_lang"), "k_target_lang": lang("target_lang"), "k_source": normalized("source_text", case_sensitive), "k_target": normalized("target_text", case_sensitive)}


def first_of(units: DataFrame, key: Sequence[Column]) -> DataFrame:
    """The unit with the smallest ordinal for each key.

    One aggregation by a 128-bit key: units are computed once and shuffled once, and each
    task keeps one unit a key before the shuffle, so a key that many units share is no large group.
    """
    sized = [F.concat_ws(":", F.length(k).cast("string"), k) for k in key]  # unambiguous when joined
    keyed = units.select(F.unhex(F.md5(F.concat(*sized))).alias("k"), F.struct("*").alias("unit"))
    return keyed.groupBy("k").agg(F.min_by("unit", F.col("unit.ordinal")).alias("unit")).select("unit.*")


def dedupe_exact(units: DataFrame, case_sensitive: bool = True, within: Sequence[str] = ()) -> DataFrame:
    """within: columns, such as file_id, of which each value is a corpus of its own."""
    return first_of(units, [*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within), *key_columns(case_sensitive).values()])


def renumbered(parts: Sequence[DataFrame]) -> DataFrame:
    """Corpora one after the other, their ordinals apart by the position in parts; an ordinal that doesn't fit fails."""
    out, own = None, F.col("ordinal")
    fits = F.when((own >= 0) & (own < 1 << 48), own).otherwise(F.raise_error(F.lit("an ordinal is not below 2**48")).cast("long"))
    for k, part in enumerate(parts):
        part = part.withColumn("ordinal", F.lit(k).cast("long") * (1 << 48) + fits)
        out = part if out is None else out.unionByName(part)
    return out


def merge(parts: Sequence[DataFrame], dedupe: bool = True, fuzzy: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    units = renumbered(parts)
    return dedupe_all(units, fuzzy=fuzzy, threshold=threshold) if dedupe else units


def trigrams(c: Column) -> Column:
    """The different runs of three characters; a shorter text is one itself, the empty text has none."""
    runs = F.regexp_extract_all(c, F.lit("(?s)(?=(.{3}))."), F.lit(1))  # linear, as substring() by position isn't
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(runs))


def side_text(lang: str, text: str) -> Column:
    """Language is part of the compared text, so another language weighs but doesn't exclude."""
    return F.concat(F.upper(F.coalesce(F.col(lang), F.lit(""))), F.lit("||"), normalized(text))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.try_divide(both, F.size(a) + F.size(b) - both))


def class_key(source: Column, target: Column) -> Column:
    """128 bits that stand for both sides' texts."""
    return F.unhex(F.md5(F.concat_ws(":", F.length(source).cast("string"), source, target)))


def classes(units: DataFrame) -> DataFrame:
    """Units that no fuzzy comparison tells apart: ordinal, and rep, the smallest ordinal among equals, by unit."""
    keyed = units.select("ordinal", class_key(side_text("source_lang", "source_text"), side_text("target_lang", "target_text")).alias("k"))
    keyed = written(keyed, "classes")  # both sides of the join read keys, not texts
    reps = keyed.groupBy("k").agg(F.min("ordinal").alias("rep"))
    return keyed.join(reps, "k").select("ordinal", "rep")


def near_pairs(units: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(a, b, source_jaccard, target_jaccard), a < b: representatives of classes of which both sides agree to threshold.

    Candidates share a band of MinHash values of their source trigrams, and each is verified by its
    trigrams, block by block (near.py): no pair is wrong, and 99.8 in 100 of those at the threshold, more of those above, are
    expected to be found (functions/minhash.py). With exact none is missed, by a join on rare
    trigrams, whose work grows as the square of a corpus in which most trigrams are common.
    """
    if not exact:
        sides = units.select("ordinal", side_text("source_lang", "source_text").alias("s"), side_text("target_lang", "target_text").alias("t"))
        return near.pairs(sides.withColumn("k", class_key(F.col("s"), F.col("t"))), threshold)
    reps = classes(units).where("ordinal = rep").select("ordinal")
    sides = units.join(reps, "ordinal", "left_semi").select("ordinal", side_text("source_lang", "source_text").alias("text"), trigrams(side_text("source_lang", "source_text")).alias("s"), trigrams(side_text("target_lang", "target_text")).alias("t"))
    sides = written(sides.withColumn("n", F.size("s")).withColumn("m", F.size("t")), "fuzzy-sides")
    found = _rare_candidates(sides, threshold)
    a = sides.select(F.col("ordinal").alias("a"), F.col("s").alias("sa"), F.col("t").alias("ta"))
    b = sides.select(F.col("ordinal").alias("b"), F.col("s").alias("sb"), F.col("t").alias("tb"))
    scored = found.join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("source_jaccard"), jaccard(F.col("ta"), F.col("tb")).alias("target_jaccard"))
    return scored.where((F.col("source_jaccard") >= threshold) & (F.col("target_jaccard") >= threshold))


def _alike(x: str, y: str, threshold: float) -> Column:
    """Sizes of which the smaller may be the threshold of the larger."""
    return F.least(x, y) >= F.greatest(x, y) * threshold - 1e-9


def _rare_candidates(sides: DataFrame, threshold: float) -> DataFrame:
    """Two sets with Jaccard t or more share one of their size - ceil(t * size) + 1 globally rarest trigrams, and the first
    they share stands early enough in both. The join's key also has the range of sizes that t allows.
    """
    tokens = sides.select("ordinal", "n", "m", F.explode("s").alias("g"))
    rarity = tokens.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    listed = tokens.join(rarity, "g").groupBy("ordinal", "n", "m").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
    size = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    prefix = listed.select("ordinal", "n", "m", F.posexplode(F.slice("gs", F.lit(1), size)).alias("k", "x")).where("x.df > 1").select("ordinal", "n", "m", "k", "x.g")
    step = -math.log(threshold) if threshold < 1 else 1.0
    band = F.floor(F.log(F.col("n").cast("double")) / step) if threshold < 1 else F.col("n").cast("long")
    near = F.array(*(band + k for k in ((-1, 0, 1) if threshold < 1 else (0,))))
    left = prefix.select(F.col("ordinal").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("k").alias("ka"), "g", F.explode(near).alias("band"))
    right = prefix.select(F.col("ordinal").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("k").alias("kb"), "g", band.alias("band"))
    # at the rarest trigram that both have, no more can be common than either has from there on
    most = F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    enough = most >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
    met = left.join(right, ["g", "band"]).where("a < b").where(_alike("na", "nb", threshold) & _alike("ma", "mb", threshold) & enough)
    return met.select("a", "b").distinct()


def greedy_removed(pairs: DataFrame) -> DataFrame:
    """(ordinal) of the nodes that a pass in order removes: those with a kept smaller neighbour.

    Each round keeps every node that no undecided smaller neighbour precedes, and removes its
    larger neighbours; so rounds grow with the longest chain of decisions, not with the data.
    """
    spark = pairs.sparkSession
    edges = written(pairs.select("a", "b").distinct(), "greedy")
    gone = spark.createDataFrame([], "ordinal long")
    while edges.limit(1).count():
        kept = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        lost = written(edges.join(kept, "a", "left_semi").select(F.col("b").alias("ordinal")).distinct(), "greedy")
        gone = gone.unionByName(lost)
        left = edges.join(lost.withColumnRenamed("ordinal", "a"), "a", "left_anti").join(lost.withColumnRenamed("ordinal", "b"), "b", "left_anti")
        now = written(left.select("a", "b"), "greedy")
        drop(edges)
        edges = now
    return gone


def dedupe_fuzzy(units: DataFrame, threshold: float | None = None, exact: bool = False) -> DataFrame:
    """A unit stays unless an earlier unit that stays resembles it on both sides. 0 and None: THRESHOLD; exact: of near_pairs()."""
    threshold = threshold or THRESHOLD
    copies = classes(units).where("ordinal <> rep").select("ordinal")
    gone = copies.unionByName(greedy_removed(near_pairs(units, threshold, exact)))
    return units.join(gone, "ordinal", "left_anti").select(units.columns)


def dedupe_all(units: DataFrame, exact: bool = True, fuzzy: bool = False, threshold: float | None = None, case_sensitive: bool = True) -> DataFrame:
    if exact:
        units = dedupe_exact(units, case_sensitive)
    return dedupe_fuzzy(written(units, "units"), threshold) if fuzzy else units
