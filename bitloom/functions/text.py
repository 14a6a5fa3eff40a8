"""Text expressions that follow Python's notions of white space, words and letters.

All but nfkc() stay in the JVM. Java's \\s, also with (?U), lacks \\x1c to \\x1f, which
Python's str.split and re count as white space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
WORD = r"(?U)[^\s\x1c-\x1f]+"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: Precomposed letters of European alphabets, which NFC and NFKC leave alone.
_STABLE = r"\x00-\x7FÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-žЀ-џ"


#: What SPACE matches with (?U), as characters.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f uses it: Spark does so in few places by itself. f has no UDF."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def token_counter(path: str) -> Callable[[Column], Column]:
    """Counts of tokens by a tokenizer file, in place of word_count(). Needs the package tokenizers."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for t in texts:
            yield pd.Series([len(x.ids) for x in tokenizer.encode_batch_fast(t.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return lambda c: count(c)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def count_of(c: Column, characters: str) -> Column:
    """How many characters are of a class. Runs are cut out, not single characters counted: that takes a third of the time."""
    return F.length(c) - F.length(F.regexp_replace(c, f"(?:{characters})+", ""))


#: What a normal form may change: characters beyond ASCII, with the one before them, with which a mark may combine.
_BEYOND = r"[\x20-\x7E]?[^\x00-\x7F]+"


def unicode_form(c: Column, form: str = "NFKC") -> Column:
    """Unicode normal form. Spark has none, so of texts that may change the parts beyond ASCII go through an Arrow UDF, a line each; other texts are nulls to it."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    beyond = F.regexp_replace(c, r"[\x00-\x7F]+", "")  # a class of many ranges takes Java 15 times as long, so it sees few characters
    other = beyond.rlike(f"[^{_STABLE}]") if form in ("NFC", "NFKC") else beyond != ""
    parts = F.split(normal(F.when(other, F.array_join(F.regexp_extract_all(c, F.lit(_BEYOND), F.lit(0)), "\n"))), "\n")
    return F.coalesce(F.array_join(F.zip_with(parts, F.split(c, _BEYOND), lambda b, a: F.concat(a, F.coalesce(b, F.lit("")))), ""), c)


def length_ratio(a: Column, b: Column) -> Column:
    """Characters of the longer over those of the shorter, the latter 1 at least."""
    return F.greatest(F.length(a), F.length(b)).cast("double") / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))
