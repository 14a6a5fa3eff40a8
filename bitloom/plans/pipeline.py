"""Whole runs: files to training data, with a count after each stage."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import CleanConfig, ConvertOptions, OutputFormat, ValidationConfig
from ..functions import language
from ..operators import analyze, clean, dedupe, formats, split, validate
from ..scratch import written
from ..sinks import write
from ..sources import tmx


@dataclass(frozen=True)
class Plan:
    clean: CleanConfig | None = CleanConfig()
    dedupe: bool = True
    fuzzy: bool = False
    threshold: float | None = None
    expand: bool = False
    keep_tags: bool = False
    options: ConvertOptions = ConvertOptions()


def prepare(units: DataFrame, plan: Plan = Plan(), within: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Units cleaned and without duplicates, and the counts. Each stage is a table, so it is computed once."""
    units = written(units, "input")
    counts = {"input": units.count()}
    if plan.clean is not None:
        units = written(clean.clean(units, plan.clean, language.detect), "cleaned")
    counts["after_clean"] = units.count()
    if plan.dedupe:
        units = written(dedupe.dedupe_exact(units, within=within), "unique")
        if plan.fuzzy:
            units = written(dedupe.dedupe_fuzzy(units, plan.threshold), "unique")
    counts["after_dedupe"] = units.count()
    return units, counts


def process_files(spark: SparkSession, files: Sequence[str], out: str, fmt: OutputFormat | str = OutputFormat.JSONL, plan: Plan = Plan(), merge: bool = False, single: bool = False) -> dict[str, dict[str, int]]:
    """Each file by itself to {stem}.{format} under out, or all as one corpus to merged.{format}; counts by file.

    These are folders of parts that the executors write, or with single files, by way of the driver.

    Files are named by their position where stems repeat. Two equal files merged count double in and once out.
    """
    fmt = OutputFormat(fmt) if isinstance(fmt, str) else fmt
    jobs = {"merged": list(files)} if merge else {}
    for k, f in enumerate(() if merge else files):
        stem = os.path.splitext(os.path.basename(f))[0]
        jobs[stem if stem not in jobs else f"{stem}-{k}"] = [f]
    results = {}
    for name, own in jobs.items():
        units = tmx.read_tmx(spark, own, plan.expand, keep_tags=plan.keep_tags)
        ready, counts = prepare(units, plan)
        path = os.path.join(out, name if fmt is OutputFormat.HF_DATASET else f"{name}.{fmt.value}")
        write.convert(ready, path, fmt, plan.options, single=single)
        output = formats.records(ready, fmt, plan.options).count() if plan.options.language_pairs else counts["after_dedupe"] * (2 if plan.options.bidirectional else 1)
        results[name] = counts | {"output": output}
    return results


def run(spark: SparkSession, files: str | Sequence[str], out: str, fmt: OutputFormat | str = OutputFormat.JSONL, plan: Plan = Plan(), test_ratio: float = 0.05, val_ratio: float = 0.05, seed: int = split.SEED, stratify: bool = False, single: bool = False) -> dict:
    """Read, clean, dedupe, validate (a report: nothing goes), count, split, write {split}_{format}.jsonl, of standard records {split}.jsonl, and metadata.json.

    Splits are folders of parts, or with single files, by way of the driver.
    """
    fmt = OutputFormat(fmt) if isinstance(fmt, str) else fmt
    ratios = (1.0 - val_ratio - test_ratio, val_ratio, test_ratio)
    split.split_sizes(0, *ratios)
    units, counts = prepare(tmx.read_tmx(spark, files, plan.expand, keep_tags=plan.keep_tags), plan)
    report = {"counts": counts, "validation": validate.report(units), "stats": analyze.summary(units)}
    if fmt is OutputFormat.HF_DATASET:
        meta = write.write_splits(units, out, plan.options, ratios, seed, stratify, single)
    else:
        parted = split.split(units, ratios, seed, ["source_lang", "target_lang"] if stratify else None)
        for name in split.NAMES:
            own = formats.records(parted.where(f"split = '{name}'").drop("split"), fmt, plan.options)
            at = os.path.join(out, f"{name}.jsonl" if fmt in formats.STANDARD else f"{name}_{fmt.value}.jsonl")
            rows = own.orderBy("ordinal", "side").drop("ordinal", "side")
            write.write_single(rows, at, OutputFormat.JSONL) if single else write.write_parts(rows, at, OutputFormat.JSONL)
        meta = split.split_counts(parted) | {"format": fmt.value, "seed": seed, "stratified": stratify} | dict(zip(("train_ratio", "val_ratio", "test_ratio"), ratios))
        write.write_json(meta, os.path.join(out, "metadata.json"))
    report["splits"] = meta
    write.write_json(report, os.path.join(out, "pipeline_report.json"))
    return report
