"""Units over the test tables, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import as_units


def shifted(text: Column, cycle: str, by: str) -> Column:
    """F.translate(text, cycle, by) for a cycle of characters: each is replaced in all the text, in half the time."""
    free = F.lit("\x01")
    order = [cycle[0]]
    while (x := by[cycle.index(order[-1])]) != cycle[0]:
        order.append(x)
    out = F.replace(text, F.lit(order[-1]), free)
    for a, b in zip(order[-2::-1], order[:0:-1]):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.contains(text, free), F.translate(text, cycle, by)).otherwise(F.replace(out, free, F.lit(order[0])))


def units_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit a document: the target is a letter-shifted copy, empty, equal, cut or with a number by doc_id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    t = shifted(text, "aeiou", "eioua")
    target = F.when(i % 17 == 0, "").when(i % 13 == 0, text).when(i % 11 == 0, F.substring(t, F.lit(1), F.floor(F.length(text) / 4).cast("int"))).when(i % 7 == 0, F.concat(t, F.lit(" 42"))).otherwise(t)
    return as_units(
        d.select(
            i.alias("ordinal"),
            i.cast("string").alias("tu_id"),
            F.upper("lang").alias("source_lang"),
            F.when(i % 5 == 0, "BG").otherwise("XX").alias("target_lang"),
            text.alias("source_text"),
            target.alias("target_text"),
            F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
        )
    )


UNITS_DOC = """units AS (SELECT doc_id AS ordinal, doc_id::VARCHAR AS tu_id, upper(lang) AS source_lang, CASE WHEN doc_id % 5 = 0 THEN 'BG' ELSE 'XX' END AS target_lang, s AS source_text,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 13 = 0 THEN s WHEN doc_id % 11 = 0 THEN substr(t, 1, length(s) // 4) WHEN doc_id % 7 = 0 THEN t || ' 42' ELSE t END AS target_text, source
  FROM (SELECT *, coalesce(text, '') AS s, translate(coalesce(text, ''), 'aeiou', 'eioua') AS t FROM documents))"""


def units_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit a user turn with the assistant turn after it, EN to BG."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source_text"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"))
    ordinal = F.col("conv_id") * 1000 + F.col("turn")
    return as_units(a.join(b, ["conv_id", "turn"]).select(ordinal.alias("ordinal"), ordinal.cast("string").alias("tu_id"), F.lit("EN").alias("source_lang"), F.lit("BG").alias("target_lang"), "source_text", "target_text"))


UNITS_TURN = """units AS (SELECT a.conv_id * 1000 + a.turn AS ordinal, (a.conv_id * 1000 + a.turn)::VARCHAR AS tu_id, 'EN' AS source_lang, 'BG' AS target_lang, coalesce(a.text, '') AS source_text, coalesce(b.text, '') AS target_text
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def units_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit a page, its markup and address, EN to FR."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    return as_units(p.select(F.col("page_id").alias("ordinal"), F.col("page_id").cast("string").alias("tu_id"), F.lit("EN").alias("source_lang"), F.lit("FR").alias("target_lang"), F.concat_ws(" ", html, url).alias("source_text"), F.concat_ws(" ", url, html).alias("target_text")))


UNITS_PAGE = """units AS (SELECT page_id AS ordinal, page_id::VARCHAR AS tu_id, 'EN' AS source_lang, 'FR' AS target_lang, coalesce(html, '') || ' ' || coalesce(url, '') AS source_text, coalesce(url, '') || ' ' || coalesce(html, '') AS target_text FROM pages)"""


def units_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit a line of a document: many repeat."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    ordinal = F.col("doc_id") * 100_000 + F.col("k")
    return as_units(d.select(ordinal.alias("ordinal"), ordinal.cast("string").alias("tu_id"), F.upper("lang").alias("source_lang"), F.lit("XX").alias("target_lang"), F.col("line").alias("source_text"), F.col("line").alias("target_text")))


UNITS_LINE = """units AS (SELECT doc_id * 100000 + k - 1 AS ordinal, (doc_id * 100000 + k - 1)::VARCHAR AS tu_id, upper(lang) AS source_lang, 'XX' AS target_lang, line AS source_text, line AS target_text
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents))"""


def entries_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry a source: for each language its first document, in the order of these."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> '' and source is not null and lang is not null")
    firsts = d.groupBy("source", F.upper("lang").alias("lang")).agg(F.min("doc_id").alias("doc_id"))
    texts = firsts.join(d.select("doc_id", F.substring("text", 1, 200).alias("text")), "doc_id")
    s = F.array_sort(F.collect_list(F.struct("doc_id", "lang", "text")))
    return texts.groupBy("source").agg(s.alias("s")).select(F.get("s", F.lit(0))["doc_id"].alias("ordinal"), F.col("source").alias("tu_id"), F.transform("s", lambda x: F.struct(x["lang"].alias("lang"), x["text"].alias("text"))).alias("segments"), F.lit("EN").alias("header_lang"))


ENTRIES = """firsts AS (SELECT source, upper(lang) AS lang, min(doc_id) AS doc_id FROM documents WHERE text <> '' AND source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
texts AS (SELECT f.*, substr(text, 1, 200) AS text FROM firsts f JOIN documents d ON f.doc_id = d.doc_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n, min(doc_id) OVER (PARTITION BY source) AS entry, bool_or(lang = 'EN') OVER (PARTITION BY source) AS has_en FROM texts)"""


#: Documents of a (source, lang) are ranked within runs of so many ids, and the runs' counts summed: no group is sorted in one task.
RUN = 4096


def entries_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry a source and rank: the document of that rank by doc_id of each language, whole, in the order of doc_id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> '' and source is not null and lang is not null")
    d = d.select("source", F.upper("lang").alias("lang"), F.floor(F.col("doc_id") / RUN).alias("run"), "doc_id", "text")
    of = ["source", "lang", "run"]
    by = Window.partitionBy("source", "lang").orderBy("run")
    base = d.groupBy(of).agg(F.count(F.lit(1)).alias("n")).select(*of, (F.sum("n").over(by) - F.col("n")).alias("base"))
    ranked = d.withColumn("k", F.row_number().over(Window.partitionBy(of).orderBy("doc_id"))).join(base, of)
    s = F.array_sort(F.collect_list(F.struct("doc_id", "lang", "text")))
    each = ranked.groupBy("source", (F.col("base") + F.col("k")).alias("rank")).agg(s.alias("s"))
    return each.select(F.get("s", F.lit(0))["doc_id"].alias("ordinal"), F.col("source").alias("tu_id"), F.transform("s", lambda x: F.struct(x["lang"].alias("lang"), x["text"].alias("text"))).alias("segments"), F.lit("EN").alias("header_lang"))


ENTRIES_BY_RANK = """ranked AS (SELECT source, upper(lang) AS lang, doc_id, text, row_number() OVER (PARTITION BY source, upper(lang) ORDER BY doc_id) AS r FROM documents WHERE text <> '' AND source IS NOT NULL AND lang IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, r ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source, r) AS n, min(doc_id) OVER (PARTITION BY source, r) AS entry FROM ranked),
pairs AS (SELECT entry, source, a.n, a.k, b.k AS other, a.lang AS source_lang, b.lang AS target_lang, a.text AS source_text, b.text AS target_text FROM numbered a JOIN numbered b USING (source, r, entry) WHERE a.k <> b.k),
plain AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY source_lang <> 'EN', k, other) AS x FROM pairs),
firsts AS (SELECT entry AS ordinal, source AS tu_id, source_lang, target_lang, source_text, target_text, n FROM plain WHERE x = 1
  UNION ALL SELECT entry, source, 'EN', lang, '', text, n FROM numbered WHERE n = 1)"""
