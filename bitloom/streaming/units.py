"""Cleaning, exact deduplication and formatting of units that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import CleanConfig, ConvertOptions, OutputFormat
from ..operators import clean, dedupe, formats
from ..schema import UNIT_SCHEMA

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_units(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Unit files (Parquet) as they come; one at a time keeps their order."""
    return spark.readStream.schema(UNIT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def unique(units: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """The first unit to arrive of each key. The state keeps every key, so use RocksDB for it: use_rocksdb()."""
    keys = dedupe.key_columns(case_sensitive)
    return units.withColumns(keys).dropDuplicates(list(keys)).drop(*keys)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start(units: DataFrame, out: str, checkpoint: str, fmt: OutputFormat | str = OutputFormat.JSONL, cfg: CleanConfig | None = CleanConfig(), opts: ConvertOptions = ConvertOptions(), dedupe_exact: bool = True, **trigger) -> StreamingQuery:
    """Clean, drop duplicates, write records as JSON lines under out. Formats that aren't lines can't stream."""
    from ..sinks.write import LINES

    fmt = OutputFormat(fmt) if isinstance(fmt, str) else fmt
    if fmt not in LINES:
        raise ValueError(f"{fmt.value} can't be written as a stream")
    if cfg is not None:
        units = clean.clean(units, cfg)
    if dedupe_exact:
        units = unique(units)
    rows = formats.records(units, fmt, opts).drop("ordinal", "side")
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
