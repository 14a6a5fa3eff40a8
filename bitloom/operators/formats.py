"""Training records: units projected to the shapes that trainers read."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ConvertOptions, OutputFormat
from ..schema import blank
from .clean import in_pairs

_ASK = "Translate the following text from {src} to {tgt}."
DEFAULTS = {
    OutputFormat.PROMPT_COMPLETION: "Translate from {src} to {tgt}:",
    OutputFormat.REASONING: f"{_ASK} Show your reasoning.",
    OutputFormat.SHAREGPT: "You are a professional translator. Translate text from {src} to {tgt}.",
}

#: Formats of plain records: the texts under their keys.
STANDARD = (OutputFormat.CSV, OutputFormat.HF_DATASET, OutputFormat.JSON, OutputFormat.JSONL, OutputFormat.PARQUET, OutputFormat.TSV)


def render(template: str) -> Column:
    """The template with language names put in; a template that asks for anything else stays as it is."""
    source, target = (F.when(blank(f"{s}_lang"), s).otherwise(F.col(f"{s}_lang")) for s in ("source", "target"))
    fields = {"src": source, "source_lang": source, "tgt": target, "target_lang": target}
    parts = []
    try:
        for text, name, form, conversion in string.Formatter().parse(template):
            if text:
                parts.append(F.lit(text))
            if name is not None:
                if form or conversion in ("r", "a"):
                    raise ValueError(template)
                parts.append(fields[name])
    except (KeyError, IndexError, ValueError):
        return F.lit(template)
    return F.concat(*parts) if parts else F.lit("")


def rejected(opts: ConvertOptions) -> Column:
    """A worse answer than the target text. Random modes draw from the seed and the ordinal, so reruns agree."""
    t, seed = F.col("target_text"), F.lit(str(opts.rejected_seed))
    draw = lambda i, what: F.conv(F.substring(F.md5(F.concat_ws(":", seed, F.col("ordinal").cast("string"), i.cast("string"), F.lit(what))), 1, 8), 16, 10).cast("long")
    words = F.filter(F.split(t, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    if opts.rejected_mode == "copy_source":
        return F.col("source_text")
    if opts.rejected_mode == "empty":
        return F.lit("")
    if opts.rejected_mode == "scramble":
        keyed = F.transform(words, lambda w, i: F.struct(draw(i, "place").alias("k"), i.alias("i"), w.alias("w")))
        return F.when(t == "", t).otherwise(F.array_join(F.array_sort(keyed)["w"], " "))
    if opts.rejected_mode == "noise":
        places = F.sequence(F.lit(1), F.floor(F.length(t) * 0.1).cast("int"))
        put = lambda s, i: F.overlay(s, F.char(33 + draw(i, "char") % 94), (draw(i, "at") % F.length(t) + 1).cast("int"), F.lit(1))
        return F.when(F.length(t) < 10, t).otherwise(F.aggregate(places, t, put))
    if opts.rejected_mode == "repetition":
        # of the words drawn, each goes in before a drawn place
        n = F.size(words)
        extra = F.transform(F.sequence(F.lit(1), F.floor(n * 0.3).cast("int")), lambda i: F.struct((draw(i, "before") % (n + 1)).cast("int").alias("p"), F.lit(0).alias("own"), i.alias("i"), F.element_at(words, (draw(i, "word") % n + 1).cast("int")).alias("w")))
        own = F.transform(words, lambda w, i: F.struct(i.alias("p"), F.lit(1).alias("own"), i.alias("i"), w.alias("w")))
        return F.when(n < 2, t).when(n < 4, F.array_join(words, " ")).otherwise(F.array_join(F.array_sort(F.concat(extra, own))["w"], " "))
    return F.substring(t, F.lit(1), F.floor(F.length(t) * F.lit(float(opts.rejected_ratio))).cast("int"))


def _chat(kind: str, body: str, turns: list[tuple[str, Column]]) -> Column:
    return F.array(*(F.struct(F.lit(who).alias(kind), what.alias(body)) for who, what in turns))


def record(fmt: OutputFormat, opts: ConvertOptions = ConvertOptions()) -> dict[str, Column]:
    """The columns of a format. A null column is a key that the record lacks."""
    s, t = F.col("source_text"), F.col("target_text")
    say = render(opts.instruction_template or DEFAULTS.get(fmt, _ASK))
    if fmt is OutputFormat.ALPACA:
        given = lambda template, text: F.lit(template) if template else text
        return {"instruction": say, "input": given(opts.input_template, s), "output": given(opts.output_template, t)}
    if fmt is OutputFormat.SHAREGPT:
        return {"conversations": _chat("from", "value", [("system", say), ("human", s), ("gpt", t)])}
    if fmt in (OutputFormat.CHATML, OutputFormat.OPENAI):
        return {"messages": _chat("role", "content", [("system", say), ("user", s), ("assistant", t)])}
    if fmt is OutputFormat.REASONING:
        thought = F.concat(F.lit("Source text in "), render("{src}"), F.lit(": '"), s, F.lit("'. Context: formal translation task.\n\nTranslation: "), t)
        return {"messages": _chat("role", "content", [("system", say), ("user", s), ("assistant", thought)])}
    if fmt is OutputFormat.DPO:
        return {"prompt": F.concat(say, F.lit("\n"), s), "chosen": t, "rejected": rejected(opts)}
    if fmt is OutputFormat.PROMPT_COMPLETION:
        return {"prompt": F.concat(say, F.lit(" "), s), "completion": t}
    out = {}
    if opts.include_id:
        out["id"] = F.when(~blank("tu_id"), F.col("tu_id"))
    if opts.lang_key:
        out |= {k: F.when(~blank(c), F.col(c)) for k, c in ((opts.source_lang_key, "source_lang"), (opts.target_lang_key, "target_lang"))}
    out |= {opts.source_key: s, opts.target_key: t}
    if opts.include_metadata:
        out["metadata"] = F.when(F.size("metadata") > 0, F.col("metadata"))
    return out


def reverse(units: DataFrame) -> DataFrame:
    """Languages and texts change sides."""
    swapped = {"source_lang": "target_lang", "target_lang": "source_lang", "source_text": "target_text", "target_text": "source_text"}
    return units.select(*(F.col(swapped.get(c, c)).alias(c) for c in units.columns))


def both_ways(units: DataFrame) -> DataFrame:
    """Each unit, and after it its reverse: column side is 0 and 1."""
    rest = [c for c in units.columns if c not in ("source_lang", "target_lang", "source_text", "target_text")]
    way = lambda a, b: F.struct(*(F.col(f"{x}_{k}").alias(f"{y}_{k}") for y, x in (("source", a), ("target", b)) for k in ("lang", "text")))
    each = units.select(*rest, F.posexplode(F.array(way("source", "target"), way("target", "source"))).alias("side", "u"))
    return each.select(*rest, "u.*", "side")


def records(units: DataFrame, fmt: OutputFormat | str, opts: ConvertOptions = ConvertOptions()) -> DataFrame:
    """ordinal, side (1 for a reversed unit) and the record's columns; order by ordinal and side for the corpus' order."""
    fmt = OutputFormat(fmt.lower()) if isinstance(fmt, str) and not isinstance(fmt, OutputFormat) else fmt
    units = units.where(in_pairs(opts.language_pairs))
    units = both_ways(units) if opts.bidirectional else units.withColumn("side", F.lit(0))
    columns = record(fmt, opts)
    if {"ordinal", "side"} & set(columns):
        raise ValueError("ordinal and side can't be keys of records")
    return units.select("ordinal", "side", *(c.alias(k) for k, c in columns.items()))
