"""Units from multilingual entries: one pair, or all ordered pairs of languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry has segments, array<struct<lang,text>> in order with each language once, and header_lang.


def first_pair(segments: str = "segments", header: str = "header_lang") -> Column:
    """struct<source_lang, target_lang, source_text, target_text> by the rules for plain reading.

    Of two languages or more, the header's is the source if it is there, and the first other the
    target; else the first two. A single language is the target, with an empty source text in
    the header's language. Else the languages are null and the texts empty.
    """
    s, h = F.col(segments), F.coalesce(F.col(header), F.lit(""))
    own = F.filter(s, lambda x: x["lang"] == h)
    others = F.filter(s, lambda x: x["lang"] != h)
    pair = lambda a, b: F.struct(a["lang"].alias("source_lang"), b["lang"].alias("target_lang"), a["text"].alias("source_text"), b["text"].alias("target_text"))
    null = F.lit(None).cast("string")
    single = F.struct(h.alias("source_lang"), s[0]["lang"].alias("target_lang"), F.lit("").alias("source_text"), s[0]["text"].alias("target_text"))
    none = F.struct(null.alias("source_lang"), null.alias("target_lang"), F.lit("").alias("source_text"), F.lit("").alias("target_text"))
    return F.when((F.size(s) >= 2) & (F.size(own) > 0), pair(F.get(own, F.lit(0)), F.get(others, F.lit(0)))).when(F.size(s) >= 2, pair(F.get(s, F.lit(0)), F.get(s, F.lit(1)))).when((F.size(s) == 1) & (h != ""), single).otherwise(none)


def all_pairs(segments: str = "segments", header: str = "header_lang") -> Column:
    """Every ordered pair of three languages or more, by source and then target; of fewer the first pair."""
    s = F.col(segments)
    each = F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b["lang"] != a["lang"]), lambda b: F.struct(a["lang"].alias("source_lang"), b["lang"].alias("target_lang"), a["text"].alias("source_text"), b["text"].alias("target_text")))))
    return F.when(F.size(s) > 2, each).otherwise(F.array(first_pair(segments, header)))


def expand(entries: DataFrame, multilingual: bool = False, most_pairs: int = 1 << 12) -> DataFrame:
    """Entries as units. ordinal becomes entry * most_pairs + pair when multilingual; an entry of more pairs fails."""
    rest = [c for c in entries.columns if c not in ("segments", "header_lang", "ordinal")]
    if not multilingual:
        return entries.select("ordinal", *rest, first_pair().alias("u")).select("ordinal", *rest, "u.*")
    each = entries.select("ordinal", *rest, F.posexplode(all_pairs()).alias("k", "u"))
    k = F.when(F.col("k") < most_pairs, F.col("k").cast("long")).otherwise(F.raise_error(F.lit(f"an entry has more than {most_pairs} pairs")).cast("long"))
    return each.select((F.col("ordinal") * most_pairs + k).alias("ordinal"), *rest, "u.*")
