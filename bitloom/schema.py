"""The row type of the engine: a translation unit, one segment in two languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ordinal is a unit's place in its corpus: "first", "next" and "earlier" go by it. It is unique.
UNIT_SCHEMA = "file_id string, ordinal long, tu_id string, source_lang string, target_lang string, source_text string, target_text string, metadata map<string,string>, notes array<string>"
UNIT_COLUMNS = [x.split()[0] for x in UNIT_SCHEMA.split(", ")]


def blank(c: Column | str) -> Column:
    """Null or empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def as_units(df: DataFrame) -> DataFrame:
    """df with all unit columns: those that are missing get their defaults, texts are never null."""
    missing = {"file_id": "cast(null as string)", "tu_id": "cast(null as string)", "source_lang": "cast(null as string)", "target_lang": "cast(null as string)", "metadata": "cast(map() as map<string,string>)", "notes": "cast(array() as array<string>)"}
    for name, default in missing.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(default))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("source_text", "target_text")]
    return df.select(*(c for c in UNIT_COLUMNS if c not in ("source_text", "target_text", "metadata", "notes")), *texts, "metadata", "notes").select(UNIT_COLUMNS)


def well_formed() -> Column:
    """Both texts and both languages are there."""
    return ~(blank("source_text") | blank("target_text") | blank("source_lang") | blank("target_lang"))


def public_view(units: DataFrame) -> DataFrame:
    return units.select(F.col("tu_id").alias("id"), "source_lang", "target_lang", F.col("source_text").alias("source"), F.col("target_text").alias("target"), "metadata", "notes")
