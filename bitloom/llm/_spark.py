"""Session helpers: tables, hash keys, and columns put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import drop, new_path, written

__all__ = ["drop", "new_path", "replaced", "sample", "table", "text_key", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def replaced(docs: DataFrame, doc: Column, text: Column) -> list[Column]:
    """The columns of docs out of the struct doc; where text isn't null it is the new text, and n_chars its length."""
    new = {"text": F.coalesce(text, doc["text"]).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(text.isNull(), doc["n_chars"]).otherwise(F.length(text).cast(kind)).alias("n_chars")
    return [new.get(c, doc[c].alias(c)) for c in docs.columns]


def sample(docs: DataFrame, known: DataFrame, label: str, rows: int, size: int) -> DataFrame:
    """text and label of the labelled documents to learn from: those of the smallest hashes of doc_id, rows at most and size bytes at most.

    known: doc_id and label, a row an id. A doc_id that documents repeat gives its smallest text.
    """
    ids = known.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first(label).alias(label))
    one = written(one, "sample")
    by = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of rows sizes
    within = one.select("doc_id", F.sum(F.octet_length("text")).over(by).alias("upto")).where(F.col("upto") <= size).select("doc_id")
    return one.join(F.broadcast(within), "doc_id").select("text", label)
