"""Settings of the operators. They are read while a plan is built: a step that is off leaves no expression."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


@dataclass(frozen=True)
class CleanConfig:
    #: Pairs such as "EN-BG" that stay; none: all.
    language_pairs: tuple[str, ...] = ()
    remove_untranslated: bool = True
    # lengths in characters and words of either side; 0 switches a limit off
    max_length: int = 10_000
    min_length: int = 1
    max_words: int = 0
    min_words: int = 0
    max_length_ratio: float = 3.0
    # steps on texts
    fix_punctuation: bool = True
    normalize_spaces: bool = True
    strip_whitespace: bool = True
    normalize_unicode: bool = True  # by unicode_form
    #: NFC, NFD, NFKC or NFKD
    unicode_form: str = "NFKC"
    preserve_placeholders: bool = False
    remove_placeholder_tags: bool = True
    remove_control_chars: bool = True
    remove_html_tags: bool = True
    remove_emails: bool = False
    remove_urls: bool = False
    pii_mask: str = "[REDACTED]"
    anonymize_pii: bool = False
    #: With a detector given to clean(): drop units whose cleaned texts are in other languages.
    lang_detect: bool = False


@dataclass(frozen=True)
class ValidationConfig:
    # errors
    require_both_nonempty: bool = True
    require_languages: bool = True
    require_different_texts: bool = True
    max_digit_mismatch_ratio: float = 1.0
    min_quality_score: float = 0.0
    # warnings
    check_noise_ratio: bool = True
    max_noise_ratio: float = 0.3
    check_no_bad_placeholders: bool = True
    check_alignment_chars: bool = True
    max_alignment_ratio: float = 5.0
    min_similar_words_ratio: float = 0.0


class OutputFormat(str, Enum):
    ALPACA = "alpaca"
    CHATML = "chatml"
    CSV = "csv"
    DPO = "dpo"
    HF_DATASET = "hf_dataset"
    JSON = "json"
    JSONL = "jsonl"
    OPENAI = "openai"
    PARQUET = "parquet"
    PROMPT_COMPLETION = "prompt_completion"
    REASONING = "reasoning"
    SHAREGPT = "sharegpt"
    TSV = "tsv"


@dataclass(frozen=True)
class ConvertOptions:
    bidirectional: bool = False
    language_pairs: tuple[str, ...] = ()
    include_id: bool = False
    include_metadata: bool = False
    lang_key: bool = True
    target_lang_key: str = "target_lang"
    source_lang_key: str = "source_lang"
    target_key: str = "target"
    source_key: str = "source"
    output_template: str | None = None
    input_template: str | None = None
    instruction_template: str | None = None
    rejected_ratio: float = 0.5
    #: truncation, scramble, noise, copy_source, empty or repetition; anything else is truncation.
    rejected_mode: str = "truncation"
    #: For the modes that draw at random.
    rejected_seed: int = 42
