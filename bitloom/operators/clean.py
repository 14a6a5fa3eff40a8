"""Cleaning: text normalisation and row filters of translation units, in an order that matters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..functions import text as T
from ..schema import blank

_DOLLAR, _SQUARE, _CURLY, _TAG = r"\$\{[^}]+\}", r"\[[^\]]+\]", r"\{[^{}]+\}", "<[^>]+>"
_PRINTF = r"%(?:[0-9]+\$)?[A-Za-z]"
#: In the order in which they are tried at a place.
TOKENS = f"{_CURLY}|{_SQUARE}|{_PRINTF}|{_DOLLAR}"
PLACEHOLDERS = f"{_CURLY}|{_SQUARE}|{_TAG}|{_PRINTF}|{_DOLLAR}"
#: What a tag or placeholder begins with.
_MARKED = r"[{\[%$<]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
URL = r"(?iU)https?://\S+|www\.\S+|ftp://\S+"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?:\+?\d{1,3}[.\s\-]?)?\(?\d{2,4}\)?[.\s\-]?\d{3,4}[.\s\-]?\d{3,4}"
CARD = r"(?U)\b(?:\d[\- ]*?){13,16}\b"
IBAN = r"(?iU)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"


def changed_where(c: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """f(c) of a text with the pattern, which no other text needs. To look for a pattern takes half the time of a replacement of it."""
    return T.once(c, lambda x: F.when(x.rlike(pattern), f(x)).otherwise(x))


def without_emails(c: Column, by: str) -> Column:
    """The pattern is tried from every character of a word on, so only texts with an @ are searched."""
    return T.once(c, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, EMAIL, by)).otherwise(x))


def keep_tokens_of_tags(c: Column) -> Column:
    """Each tag becomes the placeholder tokens in it, joined by spaces; other text stays."""
    parts = F.regexp_extract_all(c, F.lit("<[^>]+>|[^<]+|<"), F.lit(0))
    tokens = lambda p: F.array_join(F.regexp_extract_all(p, F.lit(TOKENS), F.lit(0)), " ")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^<[^>]+>"), tokens(p)).otherwise(p)), "")


#: A mark that fix_punctuation() changes, or beside which it changes something; most texts have none.
_MISPLACED = r"(?U)[.,;:!?](?:(?=[^\s\x1c-\x1f\d])|(?<=[;:!?])(?=\d)|(?<=[\s\x1c-\x1f].))"


def _punctuated(c: Column) -> Column:
    c = F.regexp_replace(c, r"([.!?])\1+", "$1")
    c = F.regexp_replace(c, rf"(?U){T.SPACE}+([.,;:!?])", "$1")
    return F.regexp_replace(c, r"(?U)([;:!?])(?=[^\s\x1c-\x1f])|([.,])(?=[^\x1c-\x1f\s\d])", "$1$2 ")


def fix_punctuation(c: Column) -> Column:
    """Repeated marks become one, no space stands before a mark and one after it; figures such as 29.99 stay."""
    return changed_where(c, _MISPLACED, _punctuated)


def mask_pii(c: Column, mask: str) -> Column:
    given = mask.replace("\\", "\\\\").replace("$", "\\$")
    c = without_emails(c, given)
    for pattern in (IBAN, CARD, PHONE):
        c = F.regexp_replace(c, pattern, given)
    return c


def _stripped(c: Column, cfg: CleanConfig) -> Column:
    c = F.coalesce(c, F.lit(""))
    return T.strip(c) if cfg.strip_whitespace else c


def _normal(c: Column, cfg: CleanConfig) -> Column:
    """Unicode form and control characters, of a stripped text."""
    if cfg.normalize_unicode:
        c = T.unicode_form(c, cfg.unicode_form)
    return changed_where(c, CONTROL, lambda x: F.regexp_replace(x, CONTROL, "")) if cfg.remove_control_chars else c


def _untagged(c: Column, cfg: CleanConfig) -> Column:
    if cfg.remove_html_tags:
        c = keep_tokens_of_tags(c) if cfg.preserve_placeholders else F.regexp_replace(c, _TAG, " ")
    if cfg.remove_placeholder_tags and not cfg.preserve_placeholders:
        c = F.regexp_replace(c, PLACEHOLDERS, " ")
    return c


def _finished(c: Column, cfg: CleanConfig) -> Column:
    """All other steps, of a normal text."""
    c = changed_where(c, _MARKED, lambda x: _untagged(x, cfg))
    if cfg.remove_urls:
        c = F.regexp_replace(c, URL, " ")
    if cfg.remove_emails:
        c = without_emails(c, " ")
    if cfg.fix_punctuation:
        c = fix_punctuation(c)
    if cfg.anonymize_pii:
        c = mask_pii(c, cfg.pii_mask)
    if cfg.normalize_spaces:
        c = T.collapse(c)
    if cfg.strip_whitespace:
        c = F.trim(c) if cfg.normalize_spaces else T.strip(c)
    return c


def clean_text(c: Column, cfg: CleanConfig = CleanConfig()) -> Column:
    return _finished(_normal(_stripped(c, cfg), cfg), cfg)


def stepwise(df: DataFrame, cfg: CleanConfig, columns: Sequence[str] = ("source_text", "target_text"), steps: Sequence[Callable[[Column, CleanConfig], Column]] = (_stripped, _normal, _finished)) -> DataFrame:
    """df with cleaned columns. Each step goes through a generator: what later ones use more than once is computed once, and no filter moves below."""
    for step in steps:
        done = F.struct(*(step(F.col(c), cfg).alias(c) for c in columns))
        df = df.select(*(c for c in df.columns if c not in columns), F.explode(F.array(done)).alias("cleaned__")).select(*(F.col(f"cleaned__.{c}") if c in columns else c for c in df.columns))
    return df


def in_pairs(pairs: Sequence[str], source: str = "source_lang", target: str = "target_lang") -> Column:
    """The languages are one of the pairs, whatever their case; no pairs: all pass."""
    if not pairs:
        return F.lit(True)
    code = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    return F.concat(code(source), F.lit("-"), code(target)).isin([p.upper() for p in pairs])


def untranslated(stripped: bool = False) -> Column:
    """The texts are equal but for case and outer space, which they may be rid of, though the languages differ."""
    lang = lambda c: F.substring(F.lower(F.col(c)), 1, 2)
    bare = lambda c: F.lower(F.col(c) if stripped else T.strip(F.col(c)))
    return ~(blank("source_lang") | blank("target_lang")) & (lang("source_lang") != lang("target_lang")) & (bare("source_text") == bare("target_text"))


def within_size(c: Column, cfg: CleanConfig) -> Column:
    ok = F.lit(True)
    if cfg.min_length:
        ok = ok & (F.length(c) >= cfg.min_length)
    if cfg.max_length:
        ok = ok & (F.length(c) <= cfg.max_length)
    if cfg.min_words:
        ok = ok & (T.word_count(c) >= cfg.min_words)
    if cfg.max_words:
        ok = ok & (T.word_count(c) <= cfg.max_words)
    return ok


def within_ratio(source: Column, target: Column, cfg: CleanConfig) -> Column:
    return T.length_ratio(source, target) <= cfg.max_length_ratio if cfg.max_length_ratio else F.lit(True)


def within_limits(source: Column, target: Column, cfg: CleanConfig) -> Column:
    return within_size(source, cfg) & within_size(target, cfg) & within_ratio(source, target, cfg)


def clean(units: DataFrame, cfg: CleanConfig = CleanConfig(), detector: Callable[[Column], Column] | None = None) -> DataFrame:
    """Units that pass, with cleaned texts; all other columns stay. Works on streams too.

    detector maps a text to a language code; it is asked only with cfg.lang_detect, and a null answer lets a unit pass.
    """
    df = units.where(~blank("source_text") & ~blank("target_text")).where(in_pairs(cfg.language_pairs))
    df = stepwise(df, cfg, steps=[_stripped])
    if cfg.remove_untranslated:
        df = df.where(~untranslated(cfg.strip_whitespace))
    df = stepwise(df, cfg, steps=[_normal])
    for lang, c in (("source_lang", "source_text"), ("target_lang", "target_text")):  # a unit whose source fails is done
        df = stepwise(df, cfg, [c], [_finished]).where((F.col(c) != "") & within_size(F.col(c), cfg))
        if cfg.lang_detect and detector is not None:
            df = df.where(blank(lang) | F.coalesce(detector(F.col(c)) == F.substring(F.lower(F.col(lang)), 1, 2), F.lit(True)))
    return df.where(within_ratio(F.col("source_text"), F.col("target_text"), cfg))
