"""Sharding by fixed virtual slots.

A record's slot is a hash of its doc_id and text, modulo SLOTS: it never changes. A
map gives each slot a shard. assign() makes the first map from the bytes per slot,
largest slots first, each to the shard that is smallest so far; so shards are near
equal in bytes (law `bytes`). grow() edits a map for one more shard: it takes slots
from the others until it has its share, and no slot goes anywhere else. save() stores
maps by version in a table.

Sizes, hashes and places are DataFrame expressions; only the SLOTS sums by slot reach
the driver, and only the map, a row a slot, is broadcast. A row's place in its shard
is the number of rows in the shard's slots before its own, plus its rank in its slot. A slot
of more than CROWDED rows is ranked in parts, by the task that read a row, and the parts put
together by a prefix sum of their counts: rows that repeat, which share a slot, are no one
task's. Equal texts of different doc_ids part: together they may be more than a shard's share.

A null text has size 1 and the empty text's CRC. Null doc_ids are spread by their
text, one doc_id with many texts as well; equal rows share a slot. A very long text is only
hashed and measured; it never leaves the scan. Other columns aren't read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import new_path, table, written

SHARDS = 16
SLOTS = 8192
#: Rows of a slot above which its ranks are counted in parts.
CROWDED = 1 << 20


def slot(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot(slots).alias("virtual_slot"), F.spark_partition_id().alias("read_by"))


def assign(sizes: dict[int, int], shards: int = SHARDS) -> dict[int, int]:
    heap = [(0, k) for k in range(shards)]
    out = {}
    for s, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        total, k = heapq.heappop(heap)
        out[s] = k
        heapq.heappush(heap, (total + size, k))
    return out


def grow(now: dict[int, int], sizes: dict[int, int]) -> dict[int, int]:
    """now with one more shard: slots move into it from the largest shard, the largest that fits its share first."""
    shards = max(now.values(), default=-1) + 1
    share, got, totals = sum(sizes.values()) / (shards + 1), 0, dict.fromkeys(range(shards), 0)
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    for s, k in sorted(now.items(), key=lambda x: (sizes.get(x[0], 0), x[0])):
        held[k].append(s)
        totals[k] += sizes.get(s, 0)
    out, heap = dict(now), [(-t, k) for k, t in totals.items()]
    heapq.heapify(heap)
    while heap:
        total, k = heapq.heappop(heap)
        while held[k] and (sizes.get(held[k][-1], 0) > share - got):
            held[k].pop()
        if held[k] and got < share:
            s = held[k].pop()
            out[s] = shards
            got += sizes.get(s, 0)
            heapq.heappush(heap, (total + sizes.get(s, 0), k))
    return out


def save(spark: SparkSession, shard_of: dict[int, int], version: int, path: str) -> None:
    """Adds a version to the table of maps; a version that is there stays, and saving it again fails."""
    rows = spark.createDataFrame(sorted(shard_of.items()), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """The map of a version; the latest by default."""
    maps = spark.read.parquet(path)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    return {x.virtual_slot: x.shard for x in maps.where(F.col("version") == version).collect()}


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by slot, at most a row a slot."""
    return {x.virtual_slot: (x.bytes, x.n) for x in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}


def place(rows: DataFrame, shard_of: dict[int, int], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """rows with shard and place, gapless from 0 in each shard."""
    before, entries = {}, []
    for s, k in sorted(shard_of.items()):
        entries.append((s, k, before.get(k, 0)))
        before[k] = before.get(k, 0) + totals.get(s, (0, 0))[1]
    spark = rows.sparkSession
    where = F.broadcast(spark.createDataFrame(entries, "virtual_slot int, shard int, base long"))
    crowded = [s for s, (_, n) in totals.items() if n > CROWDED]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", F.when(F.col("virtual_slot").isin(crowded), F.pmod("read_by", F.lit(parts))).otherwise(0)) if crowded else rows.withColumn("part", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")).cast("long")
    ranked = rows.withColumn("rank", rank).join(where, "virtual_slot")
    if crowded:
        before = Window.partitionBy("virtual_slot").orderBy("part")
        counts = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
        ahead = counts.select("virtual_slot", "part", (F.sum("n").over(before) - F.col("n")).alias("ahead"))
        ranked = ranked.join(ahead, ["virtual_slot", "part"]).withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead")
    return ranked.withColumn("place", F.col("base") + F.col("rank") - 1).drop("rank", "base", "part", "read_by")


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and place. maps: where the map is stored, as version 1."""
    rows = written(sized(docs, slots), "op5-sized")
    totals = slot_totals(rows)
    first = assign({s: b for s, (b, _) in totals.items()}, shards)
    if maps:
        save(spark, first, 1, maps)
    return place(rows, first, totals)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return shard(spark, docs, maps=new_path(spark, "op5-maps")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
