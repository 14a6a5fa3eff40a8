"""Validation: rules on a unit that give errors and warnings, a quality score, filters and reports.

A finding is a struct of a stable code, its value and a rendered message. Messages hold
numbers, so reports can be grouped by code as well as by message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ValidationConfig
from ..functions import text as T
from ..schema import blank

FINDING = "array<struct<code:string,value:string,message:string>>"
CYRILLIC_LANGUAGES = ("sr", "uk", "mk", "ru", "bg")
_NUMBER = r"(?U)\d+"
MESSAGES = {
    "empty_source": "Празен изходен текст",
    "empty_target": "Празен преведен текст",
    "no_source_lang": "Липсва изходен език",
    "no_target_lang": "Липсва целеви език",
    "same_lang": "Еднакви езици",
    "same_text": "Еднакъв текст",
    "noise_source": "Висок процент шум в source",
    "noise_target": "Висок процент шум в target",
    "numbers": "Несъвпадение на числа",
    "placeholders_missing": "Липсващи placeholder-и в превод",
    "placeholders_extra": "Лишни placeholder-и в превод",
    "alignment": "Силно разминаване в дължина",
    "similar_words": "Малко общи думи",
    "script": "Предимно латиница за кирилски език",
    "quality": "Quality score below threshold",
}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def noise_ratio(c: Column) -> Column:
    """The share of characters that aren't letters, null for the empty text; kept as 1 - x / y, on which the limit's rounding depends."""
    return F.lit(1.0) - F.try_divide(T.count_of(c, T.LETTER).cast("double"), F.length(c))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_NUMBER), F.lit(0))


def number_mismatch(source: Column | None = None, target: Column | None = None) -> Column:
    """0 where both texts have the same numbers in the same order, to 1. One pass over both texts' numbers, sorted."""
    a = numbers(_text("source_text") if source is None else source)
    b = numbers(_text("target_text") if target is None else target)
    each = lambda xs, by: F.transform(xs, lambda x: F.struct(x.alias("v"), F.lit(by).alias("by")))
    state = lambda v, n, apart: F.struct(v.alias("v"), n.alias("n"), apart.alias("apart"))
    same = lambda s, x: s["v"].eqNullSafe(x["v"])
    add = lambda s, x: state(x["v"], F.when(same(s, x), s["n"] + x["by"]).otherwise(x["by"]), F.when(same(s, x), s["apart"]).otherwise(s["apart"] + F.abs(s["n"])))
    apart = F.aggregate(F.array_sort(F.concat(each(a, 1), each(b, -1))), state(F.lit(None).cast("string"), F.lit(0), F.lit(0)), add, lambda s: s["apart"] + F.abs(s["n"]))
    ratio = apart.cast("double") / (F.size(a) + F.size(b))
    moved = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x).cast("double") / F.size(a)
    full = F.when(apart == 0, F.greatest(ratio, moved)).otherwise(ratio)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(full)


def script_counts() -> tuple[Column, Column]:
    return T.count_of(_text("target_text"), r"[\x{400}-\x{4FF}]"), T.count_of(_text("target_text"), "[A-Za-z]")


def wrong_script() -> Column:
    """The target language is written in Cyrillic, but the text mostly in Latin letters."""
    cyrillic, latin = script_counts()
    return F.substring(F.lower(_text("target_lang")), 1, 2).isin(*CYRILLIC_LANGUAGES) & (latin > cyrillic) & (latin > 3)


def quality_score(mismatch: Column | None = None) -> Column:
    """0 to 100: 100 less penalties for length, numbers, copied text and script; 0 if a side is empty."""
    s, t = _text("source_text"), _text("target_text")
    ratio = T.length_ratio(s, t)
    copied = (F.lower(T.strip(s)) == F.lower(T.strip(t))) & ~F.col("source_lang").eqNullSafe(F.col("target_lang"))
    score = F.lit(100.0) - F.when(ratio > 3.0, F.least(F.lit(30.0), (ratio - 3.0) * 10)).otherwise(0.0)
    score = score - (number_mismatch() if mismatch is None else mismatch) * 40.0 - F.when(copied, 50.0).otherwise(0.0) - F.when(wrong_script(), 40.0).otherwise(0.0)
    return F.when((s == "") | (t == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def _finding(code: str, when: Column, value: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if value is None else value.cast("string")
    message = F.concat_ws(": ", F.lit(MESSAGES[code]), value)
    return F.when(when, F.struct(F.lit(code).alias("code"), value.alias("value"), message.alias("message")))


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(c * 100, 1))


def measures() -> dict[str, Column]:
    """What more than one rule or part of a finding needs, and takes time."""
    return {"mismatch": number_mismatch(), "noise_source": noise_ratio(_text("source_text")), "noise_target": noise_ratio(_text("target_text"))}


def findings(cfg: ValidationConfig = ValidationConfig(), measured: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """Errors and warnings, in the order of the rules. measured: columns that hold measures()."""
    s, t, errors, warnings, m = _text("source_text"), _text("target_text"), [], [], measured or measures()
    if cfg.require_both_nonempty:
        errors += [_finding("empty_source", s == ""), _finding("empty_target", t == "")]
    if cfg.require_languages:
        none_s, none_t = blank("source_lang"), blank("target_lang")
        errors += [_finding("no_source_lang", none_s), _finding("no_target_lang", none_t), _finding("same_lang", ~none_s & ~none_t & (F.col("source_lang") == F.col("target_lang")))]
    if cfg.require_different_texts:
        errors.append(_finding("same_text", (s != "") & (t != "") & (T.strip(s) == T.strip(t))))
    if cfg.check_noise_ratio:
        for code, c in (("noise_source", s), ("noise_target", t)):
            warnings.append(_finding(code, (c != "") & (m[code] > cfg.max_noise_ratio), _percent(m[code])))
    if cfg.max_digit_mismatch_ratio >= 0:
        first = lambda c: F.array_join(F.slice(numbers(c), 1, 5), ", ")
        value = F.concat(_percent(m["mismatch"]), F.lit(" (src=["), first(s), F.lit("], tgt=["), first(t), F.lit("])"))
        errors.append(_finding("numbers", m["mismatch"] > cfg.max_digit_mismatch_ratio, value))
    if cfg.check_no_bad_placeholders:
        ids = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\{(\d+)\}"), F.lit(1))
        for code, a, b in (("placeholders_missing", s, t), ("placeholders_extra", t, s)):
            only = F.array_sort(F.array_except(ids(a), ids(b)))
            warnings.append(_finding(code, F.size(only) > 0, F.array_join(only, ", ")))
    if cfg.check_alignment_chars:
        ratio = T.length_ratio(s, t)
        warnings.append(_finding("alignment", (s != "") & (t != "") & (ratio > cfg.max_alignment_ratio), F.format_string("%.1f", F.bround(ratio, 1))))
    if cfg.min_similar_words_ratio > 0:
        a, b = (F.array_distinct(T.words(F.lower(c))) for c in (s, t))
        share = F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(a), F.lit(1))
        warnings.append(_finding("similar_words", (F.size(a) > 0) & (F.size(b) > 0) & (share < cfg.min_similar_words_ratio), _percent(share)))
    cyrillic, latin = script_counts()
    warnings.append(_finding("script", wrong_script(), F.concat_ws(", ", F.format_string("cyr=%d", cyrillic), F.format_string("lat=%d", latin))))
    if cfg.min_quality_score > 0:
        score = quality_score(m["mismatch"])
        errors.append(_finding("quality", score < cfg.min_quality_score, F.format_string("%.1f", F.bround(score, 1))))
    some = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast(FINDING)
    return some(errors), some(warnings)


def _measured(units: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """units with their measures, through a generator: each is computed once, however many expressions use it."""
    df = units.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in measures().items())))).alias("measured__"))
    return df, {k: F.col("measured__")[k] for k in measures()}


def validate(units: DataFrame, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """units with errors, warnings and is_valid."""
    df, measured = _measured(units)
    errors, warnings = findings(cfg, measured)
    return df.withColumns({"errors": errors, "warnings": warnings}).withColumn("is_valid", F.size("errors") == 0).drop("measured__")


def merge_results(*pairs: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Several results' (errors, warnings) as one: errors, warnings, is_valid."""
    errors, warnings = (reduce(F.concat, side) if len(side) > 1 else side[0] for side in zip(*pairs))
    return errors, warnings, F.size(errors) == 0


def filter_valid(units: DataFrame, cfg: ValidationConfig = ValidationConfig(), include_warnings: bool = True) -> DataFrame:
    df, measured = _measured(units)
    errors, warnings = findings(cfg, measured)
    ok = F.size(errors) == 0
    return df.where(ok if include_warnings else ok & (F.size(warnings) == 0)).drop("measured__")


def report_totals(units: DataFrame, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """One row: total, valid, invalid, valid_pct."""
    valid = F.count_if("is_valid")
    total = F.count(F.lit(1))
    return validate(units, cfg).agg(total.alias("total"), valid.alias("valid"), (total - valid).alias("invalid"), F.coalesce(F.try_divide(valid.cast("double"), total) * 100, F.lit(0.0)).alias("valid_pct"))


def report_findings(units: DataFrame, cfg: ValidationConfig = ValidationConfig(), by: str = "code") -> DataFrame:
    """severity, the finding's code or message, and how often: by is "code" or "message"."""
    def named(c: str, severity: str) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(severity).alias("severity"), x[by].alias(by)))

    each = F.explode(F.concat(named("errors", "error"), named("warnings", "warning")))
    return validate(units, cfg).select(each.alias("f")).groupBy("f.severity", f"f.{by}").agg(F.count(F.lit(1)).alias("n"))


def top_findings(units: DataFrame, cfg: ValidationConfig = ValidationConfig(), n: int = 15) -> DataFrame:
    return report_findings(units, cfg, "message").orderBy(F.desc("n"), "severity", "message").limit(n)


def report(units: DataFrame, cfg: ValidationConfig = ValidationConfig()) -> dict:
    """Totals and counts by message. The counts are as many as there are different messages, which hold numbers of texts; for large corpora use report_findings()."""
    out = report_totals(units, cfg).first().asDict()
    rows = report_findings(units, cfg, "message").collect()
    return out | {f"{s}_counts": {x.message: x.n for x in rows if x.severity == s} for s in ("error", "warning")}
