"""Queries that write files to the shared folder and read them back: translation memories, writers, whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConvertOptions, OutputFormat
from ..scratch import new_path
from ..sinks import write
from ..sources import tmx
from . import pipeline, views

#: Documents a file.
A_FILE = 64


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def memories(spark: SparkSession, sf_dir: str) -> list[str]:
    """A translation memory for each A_FILE documents, in order of doc_id: an entry each, of its language, XX and YY.

    Every third segment begins with an inline code, every fifth text stands in another tag, every seventh entry has a control character.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    seg = lambda t: F.concat(F.lit("<seg>"), F.when(i % 3 == 0, "<ph x='1'>{c}</ph>").otherwise(""), F.when(i % 5 == 0, F.concat(F.lit("<b>"), _escaped(t), F.lit("</b>"))).otherwise(_escaped(t)), F.lit("</seg>"))
    tuv = lambda lang, t: F.concat(F.lit("<tuv xml:lang='"), lang, F.lit("'>"), seg(t), F.lit("</tuv>\n"))
    note = F.concat(F.lit("<note> n"), i.cast("string"), F.when(i % 7 == 0, F.lit("\x0b")).otherwise(""), F.lit(" </note><prop type='source'>"), _escaped(F.coalesce("source", F.lit(""))), F.lit("</prop>"))
    entry = F.concat(F.lit("<tu tuid='"), i.cast("string"), F.lit("'>"), note, tuv(F.coalesce("lang", F.lit("zz")), text), tuv(F.lit("xx"), views.shifted(text, "aeiou", "eioua")), tuv(F.lit("yy"), views.shifted(text, "aeiou", "uaeio")), F.lit("</tu>\n"))
    head = "<?xml version='1.0' encoding='UTF-8'?>\n<tmx version='1.4'><header srclang='en' segtype='block' creationtool='t'><prop type='k'>v</prop></header><body>\n"
    files = d.select((i - i % A_FILE).alias("first"), F.struct(i.alias("doc_id"), entry.alias("entry")).alias("e")).groupBy("first").agg(F.array_sort(F.collect_list("e")).alias("e"))
    rows = files.select(F.lpad(F.col("first").cast("string"), 12, "0").alias("file"), F.concat(F.lit(head), F.array_join(F.col("e")["entry"], ""), F.lit("</body></tmx>")).alias("value"))
    at = new_path(spark, "memories")
    rows.write.partitionBy("file").text(at)
    return tmx.discover(f"{at}/*/*.txt")


def read_tmx(spark: SparkSession, sf_dir: str, expand: bool = False) -> DataFrame:
    u = tmx.read_tmx(spark, memories(spark, sf_dir), expand)
    return u.select("ordinal", "tu_id", "source_lang", "target_lang", "source_text", "target_text", F.col("metadata")["source"].alias("meta_source"), F.array_join("notes", "|").alias("notes"))


def read_tmx_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tmx(spark, sf_dir, True)


def tmx_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tmx.headers(spark, memories(spark, sf_dir))
    return h.select("file_index", "source_lang", "creation_tool", "creation_date", "seg_type", F.col("properties")["k"].alias("prop_k"))


def tmx_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tmx.broken(spark, memories(spark, sf_dir))


STANDARD = ("id", "source_lang", "target_lang", "source", "target")


def written_as(fmt: OutputFormat):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Standard records of the documents' units, written as parts of a format and read back; an empty text is null in CSV."""
        at = new_path(spark, f"sink-{fmt.value}")
        write.convert(views.units_doc(spark, sf_dir), at, fmt, ConvertOptions(include_id=True, include_metadata=fmt is not OutputFormat.PARQUET))
        schema = ", ".join(f"{c} string" for c in STANDARD)
        if fmt is OutputFormat.PARQUET:
            rows = spark.read.parquet(at)
        elif fmt in (OutputFormat.CSV, OutputFormat.TSV):
            rows = spark.read.csv(at, schema=f"{schema}, metadata string", header=True, multiLine=True, sep="\t" if fmt is OutputFormat.TSV else ",", quote='"', escape='"')
        else:
            rows = spark.read.json(at, schema=f"{schema}, metadata map<string,string>")
        return rows.select(*STANDARD[:3], *(F.coalesce(c, F.lit("")).alias(c) for c in STANDARD[3:]))

    return query


def written_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split folders of alpaca records, read back: the split of each record's instruction and texts, with the metadata's counts."""
    at = new_path(spark, "sink-splits")
    meta = write.write_splits(views.units_turn(spark, sf_dir), at, ratios=(0.8, 0.1, 0.1), single=False, fmt=OutputFormat.ALPACA)
    out = None
    for name in ("train", "validation", "test"):
        rows = spark.read.json(f"{at}/{name}.jsonl", schema="instruction string, input string, output string").withColumn("split", F.lit(name)).withColumn("size", F.lit(meta[name]).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories read, cleaned, deduplicated, validated, split and written: the report's counts."""
    report = pipeline.run(spark, memories(spark, sf_dir), new_path(spark, "sink-run"), OutputFormat.CHATML)
    counts = report["counts"] | {k: report["splits"][k] for k in ("train", "validation", "test")} | {k: report["validation"][k] for k in ("valid", "invalid")} | {k: report["stats"][k] for k in ("duplicates_found", "empty_pairs")}
    return spark.createDataFrame(sorted(counts.items()), "name string, n long")


def merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All memories twice over, as one corpus of records both ways: counts."""
    files = memories(spark, sf_dir)
    counts = pipeline.process_files(spark, [*files, *files], new_path(spark, "sink-merge"), OutputFormat.JSONL, pipeline.Plan(options=ConvertOptions(bidirectional=True)), merge=True)
    return spark.createDataFrame(sorted(counts["merged"].items()), "name string, n long")
