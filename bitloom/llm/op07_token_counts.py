"""Token counts of documents in flat token files that have no index, by a separator scan.

A token file is nothing but little-endian 16-bit ids, each document's followed by
the end-of-document id. A scan cuts every file into blocks of BLOCK_TOKENS, reads a
block with one ranged read, and finds its separators with one vectorised comparison.
Where a document began before its block, the last separator of the blocks before
tells: a prefix scan over the blocks' summaries (a running maximum of the last
separator, a running sum of the separators) by file stitches the boundaries, and
gives each document its number in the file.

write() makes such files from documents, one per task. It also returns which document
stands at which place, which the files don't tell and the scan doesn't use.

Null and empty texts have 0 tokens. Special tokens' strings in a text are ordinary
text, so no document holds the separator. Ids follow the end of a file's last
separator only if its writer was cut off: that rest is a document, not complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _files
from . import _text as T
from ._spark import new_path, table, written
from ._tokens import Encoder, default_path

SEPARATOR = 49407
BLOCK_TOKENS = 1 << 20
WIDTH = 2
BLOCKS_A_TASK = 8


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str) -> Iterator[pa.RecordBatch]:
    encoder, n = Encoder.of(path, special_as_text=True), 0
    name = f"{TaskContext.get().partitionId():06d}.tokens"
    with _files.Whole(f"{folder}/{name}") as out:
        for b in batches:
            for s in T.slices(b.column("text")):
                ids, at = encoder.encode(s)
                out.write(np.insert(ids, at[1:], SEPARATOR).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * s.rows), pa.array(np.arange(n, n + s.rows)), b.column("doc_id").slice(s.first, s.rows)], names=["file", "number", "doc_id"])
                n += s.rows


def write(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes token files under folder; result: file, number in it and doc_id of each document."""
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _write(batches, folder, path), "file string, number long, doc_id long")
    return written(rows, "op7-order")


def _separators(batches: Iterator[pa.RecordBatch], folder: str, separator: int, block: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, k in zip(b.column("file").to_pylist(), b.column("block").to_pylist()):
            fs, path = _files.at(f"{folder}/{name}")
            with fs.open_input_file(path) as f:
                ids = np.frombuffer(f.read_at(block * WIDTH, k * block * WIDTH), "<u2")
            places = np.flatnonzero(ids == separator) + k * block
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([places], pa.list_(pa.int64()))], names=["file", "block", "places"])


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, block: int = BLOCK_TOKENS) -> DataFrame:
    """file, number in it, n_tokens (without the separator) and complete, of each document in the token files under folder."""
    sizes = _files.listed(folder, ".tokens")
    tasks = sum(-(-size // (WIDTH * block)) for _, size in sizes) // BLOCKS_A_TASK + 1  # a number, else rows as few would be one task's
    files = spark.createDataFrame(sizes, "file string, bytes long").withColumn("ids", F.expr(f"bytes div {WIDTH}"))
    blocks = files.where("ids > 0").select("file", F.explode(F.expr(f"sequence(0L, (ids - 1) div {block})")).alias("block"))
    found = blocks.repartition(tasks).mapInArrow(lambda batches: _separators(batches, folder, separator, block), "file string, block long, places array<long>")
    found = written(found.withColumn("n", F.size("places").cast("long")).withColumn("last", F.try_element_at("places", F.lit(-1))), "op7-separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("number"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("back"))
    each = found.join(stitched, ["file", "block"]).select("file", "number", "back", "places", F.posexplode("places").alias("k", "place"))
    whole = each.select("file", (F.col("number") + F.col("k")).alias("number"), (F.col("place") - F.coalesce(F.get("places", F.col("k") - 1), "back") - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    ends = found.groupBy("file").agg(F.sum("n").alias("number"), F.coalesce(F.max("last"), F.lit(-1)).alias("back"))
    rest = files.join(ends, "file").where("ids - 1 > back").select("file", "number", (F.col("ids") - 1 - F.col("back")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "op7-tokens")
    order = write(spark, table(spark, sf_dir, "documents"), folder)
    return order.join(count_tokens(spark, folder), ["file", "number"]).select("doc_id", "n_tokens")
