"""One query for each operator of the engine, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanConfig, ConvertOptions, OutputFormat, ValidationConfig
from ..functions import language
from ..operators import analyze, clean, dedupe, expand, formats, pack, split, validate
from . import roundtrips, views

Query = Callable[[SparkSession, str], DataFrame]
UNIT = ("ordinal", "tu_id", "source_lang", "target_lang", "source_text", "target_text")


def over(view: Callable[[SparkSession, str], DataFrame], f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(view(spark, sf_dir))


doc, turn, page, line = ((lambda f, v=v: over(v, f)) for v in (views.units_doc, views.units_turn, views.units_page, views.units_line))


def texts(cfg: CleanConfig) -> Callable[[DataFrame], DataFrame]:
    return lambda u: u.select("ordinal", *(clean.clean_text(F.col(c), cfg).alias(c) for c in ("source_text", "target_text")))


def codes(c: str):
    return F.array_join(F.col(c)["code"], ",").alias(c)


def record(fmt: OutputFormat, **opts) -> Query:
    return turn(lambda u: formats.records(u, fmt, ConvertOptions(**opts)))


def chat(fmt: OutputFormat, column: str, role: str, body: str) -> Query:
    """A row a turn."""
    return turn(lambda u: formats.records(u, fmt).select("ordinal", F.posexplode(column).alias("turn", "c")).select("ordinal", "turn", F.col("c")[role].alias("role"), F.col("c")[body].alias("content")))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = views.units_doc(spark, sf_dir), views.units_turn(spark, sf_dir)
    return dedupe.merge([one, two, one]).select("ordinal")


def standard(u: DataFrame) -> DataFrame:
    rows = formats.records(u, OutputFormat.JSONL, ConvertOptions(include_id=True, include_metadata=True))
    return rows.withColumn("meta_source", F.col("metadata")["source"]).drop("metadata")


def finding_values(u: DataFrame) -> DataFrame:
    """A row a finding, with its value and message; a rule on common words and a gate on quality among them."""
    found = validate.validate(u, ValidationConfig(min_similar_words_ratio=0.5, min_quality_score=60.0, max_digit_mismatch_ratio=0.1))
    return found.select("ordinal", F.explode(F.concat("errors", "warnings")).alias("f")).select("ordinal", "f.code", "f.value", "f.message")


def detected(u: DataFrame) -> DataFrame:
    return clean.clean(u.withColumn("target_lang", F.col("source_lang")), CleanConfig(lang_detect=True, remove_untranslated=False), language.detect).select("ordinal")


TEMPLATES = {"instruction_template": "{source_lang}>{tgt}: {{as is}}", "input_template": "see above"}

QUERIES: dict[str, Query] = {
    "read_tmx": roundtrips.read_tmx,
    "read_tmx_expanded": roundtrips.read_tmx_expanded,
    "tmx_headers": roundtrips.tmx_headers,
    "tmx_repairs": roundtrips.tmx_repairs,
    **{f"sink_{x.value}": roundtrips.written_as(x) for x in (OutputFormat.JSONL, OutputFormat.JSON, OutputFormat.CSV, OutputFormat.TSV, OutputFormat.PARQUET)},
    "sink_splits": roundtrips.written_splits,
    "run_pipeline": roundtrips.run_pipeline,
    "merge_files": roundtrips.merge_files,
    "unicode_nfc": doc(lambda u: u.select("ordinal", *(clean.T.unicode_form(F.concat(F.col(c), F.lit(" e\u0301 \u1e9b\u0323 \ufb01")), "NFC").alias(c) for c in ("source_text", "target_text")))),
    "detect_language": doc(lambda u: u.select("ordinal", language.detect(F.col("source_text")).alias("lang"))),
    "filter_detected_language": doc(detected),
    "validation_values": doc(finding_values),
    "top_findings": doc(validate.top_findings),
    "export_pairs": doc(lambda u: formats.records(u, OutputFormat.PROMPT_COMPLETION, ConvertOptions(language_pairs=("en-bg", "fr-xx")))),
    "format_templates": turn(lambda u: formats.records(u, OutputFormat.ALPACA, ConvertOptions(**TEMPLATES))),
    "clean_dedupe_pair_stats": doc(lambda u: analyze.pair_counts(dedupe.dedupe_exact(clean.clean(u)))),
    "clean_units": doc(lambda u: clean.clean(u).select(*UNIT)),
    "clean_html_urls": page(texts(CleanConfig(remove_urls=True))),
    "clean_emails": doc(texts(CleanConfig(remove_emails=True))),
    "clean_preserve_placeholders": page(texts(CleanConfig(preserve_placeholders=True))),
    "mask_pii": doc(texts(CleanConfig(anonymize_pii=True, fix_punctuation=False))),
    "unicode_nfkc": doc(lambda u: u.select("ordinal", clean.T.unicode_form(F.col("source_text")).alias("source_text"))),
    "filter_language_pair": doc(lambda u: u.where(clean.in_pairs(["en-bg", "FR-XX"])).select(*UNIT)),
    "filter_untranslated": doc(lambda u: u.where(~clean.untranslated()).select("ordinal")),
    "filter_length_words_ratio": doc(lambda u: u.where(clean.within_limits(F.col("source_text"), F.col("target_text"), CleanConfig(min_length=100, max_length=5000, min_words=30, max_words=600, max_length_ratio=1.01))).select("ordinal")),
    "valid_units": doc(lambda u: analyze.valid_units(u).select("ordinal")),
    "list_languages": doc(analyze.languages),
    "list_pairs": doc(analyze.pairs),
    "list_target_languages": doc(analyze.target_languages),
    "expand_multilingual": over(views.entries_by_source, lambda e: expand.expand(e.where(F.size("segments") > 2), multilingual=True)),
    "first_pair": over(views.entries_by_source, lambda e: expand.expand(e.where(F.size("segments") > 1))),
    "expand_multilingual_whole": over(views.entries_by_rank, lambda e: expand.expand(e, multilingual=True)),
    "first_pair_whole": over(views.entries_by_rank, expand.expand),
    "validate_flags": doc(lambda u: validate.validate(u).select("ordinal", "is_valid", codes("errors"), codes("warnings"))),
    "number_mismatch_ratio": doc(lambda u: u.select("ordinal", validate.number_mismatch().alias("mismatch"))),
    "quality_score": doc(lambda u: u.select("ordinal", validate.quality_score().alias("score"))),
    "quality_gate": doc(lambda u: validate.filter_valid(u, ValidationConfig(min_quality_score=60.0)).select("ordinal")),
    "validation_report": doc(validate.report_findings),
    "validation_totals": doc(validate.report_totals),
    "filter_valid_strict": doc(lambda u: validate.filter_valid(u, include_warnings=False).select("ordinal")),
    "similar_words": doc(lambda u: validate.validate(u, ValidationConfig(min_similar_words_ratio=0.5)).where(F.exists("warnings", lambda x: x["code"] == "similar_words")).select("ordinal")),
    "dedupe_exact": line(lambda u: dedupe.dedupe_exact(u).select("ordinal")),
    "dedupe_exact_ci": line(lambda u: dedupe.dedupe_exact(u, case_sensitive=False).select("ordinal")),
    "merge_dedupe": merged,
    "near_duplicate_pairs": doc(dedupe.near_pairs),
    "near_duplicate_classes": doc(dedupe.classes),
    "dedupe_fuzzy": doc(lambda u: dedupe.dedupe_fuzzy(u).select("ordinal")),
    "dataset_stats": doc(analyze.stats),
    "stats_pairs": doc(analyze.pair_counts),
    "top_pairs": doc(analyze.top_pairs),
    "stats_languages": doc(analyze.language_counts),
    "duplicate_count": doc(analyze.duplicates),
    "token_estimates": doc(analyze.token_estimates),
    "readiness": doc(analyze.readiness),
    "terminology": turn(analyze.terminology),
    "concordance": doc(lambda u: analyze.concordance(u, "The IN")),
    "pack_context": turn(lambda u: pack.pack(u, 2048)),
    "pack_context_wide": turn(lambda u: pack.pack(u, 8192)),
    "preview_page": doc(lambda u: analyze.page(u, 50, 25).select(*UNIT)),
    "preview_rows": doc(analyze.preview),
    "format_standard": doc(standard),
    "format_alpaca": record(OutputFormat.ALPACA),
    "format_prompt_completion": record(OutputFormat.PROMPT_COMPLETION),
    "format_sharegpt": chat(OutputFormat.SHAREGPT, "conversations", "from", "value"),
    "format_chatml": chat(OutputFormat.CHATML, "messages", "role", "content"),
    "format_openai": chat(OutputFormat.OPENAI, "messages", "role", "content"),
    "format_reasoning": chat(OutputFormat.REASONING, "messages", "role", "content"),
    "bidirectional": record(OutputFormat.JSONL, bidirectional=True),
    **{f"dpo_{mode}": record(OutputFormat.DPO, rejected_mode=mode) for mode in ("truncation", "copy_source", "empty", "scramble", "noise", "repetition")},
    "split_random": doc(lambda u: split.split(u).select("ordinal", "split")),
    "split_stratified": doc(lambda u: split.split(u, (0.8, 0.1, 0.1), strata=["source_lang", "target_lang"]).select("ordinal", "split")),
}
