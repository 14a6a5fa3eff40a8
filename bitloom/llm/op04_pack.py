"""Packing into sequences of at most LIMIT tokens, shortest pack first over the length histogram.

A document is its ids and an end id, cut into pieces of LIMIT and a rest. One pass
tokenises and writes a row a piece; texts are never shuffled. The histogram has at
most LIMIT bins, whatever the input: the driver places its lengths longest first,
each into the packs that are shortest so far, as long as some have room, else into
new ones. Packs of equal content are one pattern with a count, so a step places many
pieces at once; it covers a range of ranks among the pieces of its length and a range
of sequences. Pieces then find their step by rank. Ranks are counted by (length,
hash bucket) and put together by a prefix sum over the counts: a length that a third
of all pieces have is no single group.

Null and empty texts are one piece, the end id. Null doc_ids and repeated rows are
packed like any other.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import table, written
from ._tokens import Encoder, default_path

LIMIT = 4096
END = 2


def _pieces(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(path)
    for b in batches:
        for s in T.slices(b.column("text")):
            ids, at = encoder.encode(s)
            row, start, length, crc, total = [], [], [], [], []
            for i in range(s.rows):
                own = np.append(ids[at[i] : at[i + 1]], END).astype("<u4")
                for k in range(0, len(own), limit):
                    piece = own[k : k + limit]
                    row.append(s.first + i)
                    start.append(k)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def place(histogram: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Steps as rows (length, first rank, ranks, first sequence, offset), by length and rank."""
    room: dict[int, list[tuple[int, int]]] = {}  # by free tokens: (first sequence, sequences)
    heap: list[int] = []
    steps, sequences = [], 0

    def put(free: int, first: int, n: int) -> None:
        if free:
            if free not in room:
                room[free] = []
                heapq.heappush(heap, -free)
            room[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if heap and -heap[0] >= length:
                free = -heap[0]
                first, n = room[free].pop()
                used = min(n, left)
                if used < n:
                    room[free].append((first + used, n - used))
                if not room[free]:
                    del room[free]
                    heapq.heappop(heap)
            else:
                free, first, used = limit, sequences, left
                sequences += left
            steps.append((length, rank, used, first, limit - free))
            put(free - length, first, used)
            rank += used
            left -= used
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def _assign(batches: Iterator[pa.RecordBatch], steps) -> Iterator[pa.RecordBatch]:
    length, first_rank, _, sequence, offset = np.ascontiguousarray(steps.value.T)
    key = (length << 44) + first_rank
    for b in batches:
        rank = b.column("rank").to_numpy()
        at = np.searchsorted(key, (b.column("length").to_numpy() << 44) + rank, "right") - 1
        columns = [*(b.column(c) for c in b.schema.names if c != "rank"), pa.array(sequence[at] + rank - first_rank[at]), pa.array(offset[at])]
        yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _pieces(batches, path, limit), schema), "op4-pieces")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = written(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "op4-counts")
    steps = spark.sparkContext.broadcast(place({x.length: x.n for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(lambda batches: _assign(batches, steps), f"{schema}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
