"""Command line: python -m bitloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import scratch
from .config import CleanConfig, ConvertOptions, OutputFormat
from .functions import language
from .operators import analyze, clean, dedupe, validate
from .plans import pipeline
from .sinks import write
from .sources import tmx


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("bitloom", description="Prepare parallel corpora for training.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *, out: bool = False, many: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=what)
        c.add_argument("files", nargs="+" if many else 1)
        if out:
            c.add_argument("-o", "--output", required=True)
        c.add_argument("--expand", action="store_true")
        c.add_argument("--preserve-tags", action="store_true")
        return c

    def cleaning(c: argparse.ArgumentParser, lang_detect: bool = False) -> None:
        c.add_argument("--clean", action=argparse.BooleanOptionalAction, default=True)
        c.add_argument("--dedupe", action=argparse.BooleanOptionalAction, default=True)
        c.add_argument("--fuzzy", action="store_true")
        c.add_argument("--preserve-placeholders", action="store_true")
        c.add_argument("--pairs", nargs="*", default=[])
        c.add_argument("--lang-pairs", default="", help="pairs with commas between, such as EN-BG,BG-EN")
        for name, kind, default in (("min-len", int, 1), ("max-len", int, 10_000), ("min-words", int, 0), ("max-words", int, 0), ("max-ratio", float, 3.0)):
            c.add_argument(f"--{name}", type=kind, default=default)
        c.add_argument("--remove-html", dest="remove_html", action="store_true", default=True)
        c.add_argument("--keep-html", dest="remove_html", action="store_false")
        c.add_argument("--remove-urls", action="store_true")
        c.add_argument("--remove-emails", action="store_true")
        c.add_argument("--mask-pii", action="store_true")
        c.add_argument("--lang-detect", action="store_true")

    def converting(c: argparse.ArgumentParser) -> None:
        c.add_argument("-f", "--format", "--fmt", default="jsonl", type=str.lower, choices=[x.value for x in OutputFormat])
        c.add_argument("--bidirectional", action="store_true")
        c.add_argument("--include-id", action="store_true")
        c.add_argument("--include-metadata", action="store_true")
        c.add_argument("--rejected-mode", default="truncation")
        c.add_argument("--rejected-ratio", type=float, default=0.5)
        c.add_argument("--instruction")

    c = command("parse", "read units", out=False)
    c.add_argument("-o", "--output")
    c.add_argument("-n", "--limit", type=int, default=0)
    c.add_argument("-s", "--sample", type=int, default=5)
    c = command("clean", "write cleaned units, by the output's suffix", out=True, many=True)
    cleaning(c)
    c = command("convert", "clean, dedupe and write records", out=True)
    cleaning(c)
    converting(c)
    c.add_argument("--parts", action="store_true", help="a folder of parts instead of one file")
    c.add_argument("--streaming", action="store_true", help="write records in one pass over the files, as parts; needs --no-dedupe")
    c = command("validate", "report on units as they are")
    c.add_argument("-o", "--output")
    c = command("stats", "count units")
    c.add_argument("-o", "--output")
    for name, what, many in (("pipeline", "read to splits", False), ("batch", "files one by one", True), ("merge", "files as one corpus", True)):
        c = command(name, what, out=True, many=many)
        cleaning(c)
        converting(c)
        c.add_argument("--single", action="store_true", help="single files, by way of the driver, instead of folders of parts")
        c.add_argument("--val-ratio", type=float, default=0.05)
        c.add_argument("--test-ratio", type=float, default=0.05)
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--stratify", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    a = parser.parse_args(argv)
    if a.command == "convert" and a.streaming and (a.dedupe or a.format == OutputFormat.HF_DATASET.value):
        parser.error("--streaming needs --no-dedupe" if a.dedupe else "--streaming can't write splits")
    spark = spark or SparkSession.builder.appName("bitloom").getOrCreate()
    files = [f for x in a.files for f in tmx.discover(x)]
    if not files:
        print("no such file", file=sys.stderr)
        return 2
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2))
    if a.command in ("parse", "validate", "stats", "clean", "convert"):
        units = tmx.read_tmx(spark, files, a.expand, keep_tags=a.preserve_tags)
    if a.command in ("clean", "convert", "pipeline", "batch", "merge"):
        pairs = (*a.pairs, *(p.strip() for p in a.lang_pairs.split(",") if p.strip()))
        cfg = CleanConfig(
            language_pairs=pairs, min_length=a.min_len, max_length=a.max_len, min_words=a.min_words, max_words=a.max_words, max_length_ratio=a.max_ratio, remove_html_tags=a.remove_html,
            remove_urls=a.remove_urls, remove_emails=a.remove_emails, anonymize_pii=a.mask_pii, lang_detect=a.lang_detect, preserve_placeholders=a.preserve_placeholders,
        )
    if a.command in ("convert", "pipeline", "batch", "merge"):
        opts = ConvertOptions(bidirectional=a.bidirectional, include_id=a.include_id, include_metadata=a.include_metadata, rejected_mode=a.rejected_mode, rejected_ratio=a.rejected_ratio, instruction_template=a.instruction)
        plan = pipeline.Plan(clean=cfg if a.clean else None, dedupe=a.dedupe, fuzzy=a.fuzzy, expand=a.expand, keep_tags=a.preserve_tags, options=opts)
    if a.command == "parse":
        if a.limit:
            units = units.orderBy("ordinal").limit(a.limit)
        if a.output:
            write.dump_units(units, a.output)
        header = tmx.headers(spark, files).orderBy("file_index").first().asDict()
        show({"header": header, "units": units.count(), "stats": analyze.summary(units), "sample": [x.asDict() for x in analyze.preview(units, a.sample, 150).collect()]})
    elif a.command == "clean":
        before = units.count()
        ready = scratch.written(clean.clean(units, cfg, language.detect) if a.clean else units, "cleaned")
        after = ready.count()
        ready = dedupe.dedupe_all(ready, fuzzy=a.fuzzy) if a.dedupe else ready
        fmt = write.by_suffix(a.output)
        write.convert(ready, a.output, fmt, ConvertOptions(include_id=True), single=fmt is not OutputFormat.PARQUET)
        show({"before": before, "after": after, "removed": before - after})
    elif a.command == "convert" and a.streaming:
        ready = clean.clean(units, cfg, language.detect) if a.clean else units
        write.convert(ready, a.output, a.format, opts)
        show({"streamed": True})
    elif a.command == "convert":
        ready, counts = pipeline.prepare(units, plan)
        write.convert(ready, a.output, a.format, opts, **({} if a.format == "hf_dataset" else {"single": not a.parts}))
        show(counts)
    elif a.command in ("validate", "stats"):
        found = validate.report(units) if a.command == "validate" else analyze.summary(units)
        if a.output:
            write.write_json(found, a.output)
        show(found)
    elif a.command == "pipeline":
        show(pipeline.run(spark, files, a.output, a.format, plan, a.test_ratio, a.val_ratio, a.seed, a.stratify, a.single)["counts"])
    else:
        show(pipeline.process_files(spark, files, a.output, a.format, plan, merge=a.command == "merge", single=a.single))
    return 0


if __name__ == "__main__":
    sys.exit(main())
