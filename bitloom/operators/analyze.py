"""Statistics of a corpus, term extraction and concordance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import blank, well_formed

RATES = {"llama3": 1.35, "qwen": 1.25, "gpt4": 1.30, "mistral": 1.32}
SIDES = ("source", "target")


def with_texts() -> Column:
    """Both texts are there: the units that statistics are about."""
    return ~blank("source_text") & ~blank("target_text")


def _measures(columns: dict[str, str]) -> dict[str, Column]:
    out = {}
    for name, c in columns.items():
        size = F.when(with_texts(), F.col(c))
        for kind, f in (("sum", F.sum), ("min", F.min), ("max", F.max)):
            out[f"{name}_{kind}"] = F.coalesce(f(size), F.lit(0)).cast("long")
        out[f"{name}_avg"] = F.coalesce(F.avg(size), F.lit(0.0))
    return out


def stats(units: DataFrame, count: Callable[[Column], Column] = T.word_count) -> DataFrame:
    """One row: units in all, with texts and without, and sums, least, most and averages of characters and words.

    count: what counts as words, such as tokens by functions.text.token_counter().
    """
    sizes = {f"{side}_{unit}": f(F.col(f"{side}_text")) for side in SIDES for unit, f in (("chars", lambda c: F.length(c).cast("long")), ("words", count))}
    sized = units.select("source_text", "target_text", *(c.alias(f"{k}__") for k, c in sizes.items()))
    total, valid = F.count(F.lit(1)), F.count_if(with_texts())
    return sized.agg(total.alias("total_units"), valid.alias("valid_units"), (total - valid).alias("empty_pairs"), *(c.alias(k) for k, c in _measures({k: f"{k}__" for k in sizes}).items()))


def pair_counts(units: DataFrame) -> DataFrame:
    name = lambda c: F.when(blank(c), "UNK").otherwise(F.col(c)).alias(c)
    return units.where(with_texts()).groupBy(name("source_lang"), name("target_lang")).agg(F.count(F.lit(1)).alias("n"))


def top_pairs(units: DataFrame, n: int = 10) -> DataFrame:
    return pair_counts(units).orderBy(F.desc("n"), "source_lang", "target_lang").limit(n)


def language_counts(units: DataFrame) -> DataFrame:
    """(side, lang, n) by one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_lang").alias("lang")) for s in SIDES)))
    return units.where(with_texts()).select(each.alias("x")).where(~blank("x.lang")).groupBy("x.side", "x.lang").agg(F.count(F.lit(1)).alias("n"))


def duplicates(units: DataFrame) -> DataFrame:
    """One row: how many units repeat an earlier one, texts taken as they are."""
    key = F.md5(F.concat(*(F.concat_ws(":", F.length(c).cast("string"), c) for c in (F.coalesce(F.col(x), F.lit("")) for x in ("source_lang", "target_lang", "source_text", "target_text")))))
    each = units.where(with_texts()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_found"))


def _words_in_all() -> Column:
    return F.col("source_words_sum") + F.col("target_words_sum")


def token_estimates(units: DataFrame) -> DataFrame:
    return stats(units).select(*(F.floor(_words_in_all() * F.lit(r)).cast("long").alias(f"{k}_estimated_tokens") for k, r in RATES.items()))


def readiness(units: DataFrame) -> DataFrame:
    tokens = F.floor(_words_in_all() * F.lit(RATES["llama3"])).cast("long")
    ready = (F.col("valid_units") >= 10) & (tokens >= 100)
    return stats(units).select(
        ready.alias("is_ready"),
        F.when(ready, "ГОТОВ ЗА FINE-TUNING").otherwise("НЕДОСТАТЪЧНО ДАННИ").alias("dataset_status"),
        F.col("valid_units").alias("total_valid_units"),
        tokens.alias("total_llm_tokens_est"),
        F.when(F.col("valid_units") < 10_000, 3).otherwise(1).alias("recommended_epochs"),
    )


def summary(units: DataFrame) -> dict:
    """All of it as one nested dict. The languages and pairs of a corpus are few."""
    s = stats(units).first().asDict()
    side = lambda x: {f"{a}_{u}": s[f"{x}_{u}_{k}"] for u in ("chars", "words") for a, k in (("avg", "avg"), ("max", "max"), ("min", "min"), ("total", "sum"))}
    langs = language_counts(units).collect()
    return {
        **{k: s[k] for k in ("total_units", "valid_units", "empty_pairs")},
        "duplicates_found": duplicates(units).first()[0],
        "language_pairs": {f"{x.source_lang}-{x.target_lang}": x.n for x in pair_counts(units).collect()},
        **{f"{k}_languages": {x.lang: x.n for x in langs if x.side == k} for k in SIDES},
        "readiness": readiness(units).first().asDict() | {"token_estimates": token_estimates(units).first().asDict()},
        **{k: side(k) for k in SIDES},
    }


def _pairs_counted(sides: DataFrame) -> DataFrame:
    """How many rows hold each pair of a word of s and a word of t."""
    pairs = sides.select(F.explode("s").alias("source_term"), "t").select("source_term", F.explode("t").alias("target_term"))
    return pairs.groupBy("source_term", "target_term").agg(F.count(F.lit(1)).alias("frequency"))


def terminology(units: DataFrame, min_freq: int = 2, max_terms: int = 50) -> DataFrame:
    """Pairs of words that most units hold on either side: source_term, target_term, frequency; ties by the terms.

    A pair is no more frequent than its words. The pairs of each side's most frequent words are counted first: where
    max_terms of them are found in n units, no pair of a word in fewer than n is among the first, and such words drop
    out before all pairs of the others are made and counted. Where all words are about as frequent few drop out, and
    the counts of pairs go to disk.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(T.LETTER + "{3,}"), F.lit(0)))
    both = units.where(with_texts()).select("ordinal", words("source_text").alias("s"), words("target_text").alias("t"))
    each = {c: both.select("ordinal", F.explode(c).alias(c)) for c in ("s", "t")}
    often = {c: x.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_freq) for c, x in each.items()}
    first = both
    for c, x in often.items():
        top = x.orderBy(F.desc("n"), c).limit(4 * max_terms).agg(F.collect_list(c).alias("top"))
        first = first.crossJoin(F.broadcast(top)).withColumn(c, F.array_intersect(c, "top")).drop("top")
    found = _pairs_counted(first).orderBy(F.desc("frequency")).limit(max_terms)
    least = found.agg(F.greatest(F.lit(min_freq), F.when(F.count(F.lit(1)) == max_terms, F.min("frequency"))).alias("least"))
    sides = []
    for c in ("s", "t"):
        kept = often[c].crossJoin(F.broadcast(least)).where("n >= least").select(c)
        sides.append(each[c].join(kept, c).groupBy("ordinal").agg(F.collect_list(c).alias(c)))
    counts = _pairs_counted(sides[0].join(sides[1], "ordinal")).where(F.col("frequency") >= min_freq)
    return counts.orderBy(F.desc("frequency"), "source_term", "target_term").limit(max_terms)


def concordance(units: DataFrame, query: str, max_results: int = 50) -> DataFrame:
    """The first units with query, as it is but for case, in either text."""
    if not query or max_results <= 0:
        units = units.limit(0)
    found = F.lower("source_text").contains(query.lower()) | F.lower("target_text").contains(query.lower())
    rows = units.where(with_texts() & found).orderBy("ordinal").limit(max(max_results, 0))
    return rows.select(F.col("tu_id").alias("id"), "source_lang", "target_lang", "source_text", "target_text")


def languages(units: DataFrame) -> DataFrame:
    return units.select(F.explode(F.array("source_lang", "target_lang")).alias("lang")).where(~blank("lang")).distinct().orderBy("lang")


def pairs(units: DataFrame) -> DataFrame:
    return units.where(~blank("source_lang") & ~blank("target_lang")).select("source_lang", "target_lang").distinct().orderBy("source_lang", "target_lang")


def target_languages(units: DataFrame) -> DataFrame:
    """Target languages in the order in which they first occur."""
    return units.where(~blank("target_lang")).groupBy("target_lang").agg(F.min("ordinal").alias("first")).orderBy("first").select("target_lang")


def valid_units(units: DataFrame) -> DataFrame:
    return units.where(well_formed())


def page(units: DataFrame, start: int = 0, limit: int = 50) -> DataFrame:
    return units.orderBy("ordinal").offset(start).limit(limit)


def preview(units: DataFrame, n: int = 5, chars: int = 120) -> DataFrame:
    return units.orderBy("ordinal").limit(n).select("tu_id", "source_lang", "target_lang", *(F.substring(c, 1, chars).alias(c) for c in ("source_text", "target_text")))


def delta(before: DataFrame, after: DataFrame) -> dict[str, int]:
    b, a = before.count(), after.count()
    return {"before": b, "after": a, "removed": b - a}
