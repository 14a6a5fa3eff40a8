"""WARC archives compressed by a shared Zstandard dictionary.

write() finds equal payloads by their SHA-1 (partial aggregation by digest, then a join
that splits skewed digests), writes one response for the smallest page_id of each and
revisits for the others, a WARC/1.1 record and a Zstandard frame each. The dictionary is
trained on whole records of about SAMPLE digests, the share of them that is smallest, one
record each and SAMPLE_BYTES of payloads in all at most, and stands in a leading skippable
frame of every archive, so an archive can be read by itself. A task writes its archives
under final names once complete. Names hold the task's attempt, since an attempt may get its
rows in another order: the result lists the archives of the attempts that count, and those of
others are in no list. read() streams archives back, record by record, and verifies every
payload's digest.

A null html is an empty payload. A null page_id is larger than any other; rows that repeat
both page_id and payload are all responses if that id is the smallest. Null urls are left out
of the record; control characters and spaces in a url are percent-encoded there. A very long
payload is held a few times over while its record is written or read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _files
from ._spark import new_path, table, written

MAGIC = 0x184D2A5D
SAMPLE = 1500
SAMPLE_BYTES = 24 << 20
DICTIONARY_BYTES = 110 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
MIN_REVISIT = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def dictionary(samples: list[bytes]) -> bytes:
    """Trained where there is enough to train on, else some of the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = url and "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    fields = [("WARC-Record-ID", _id(page, digest)), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", None if page is None else str(page)), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(first, digest)), ("X-Refers-To-Page-ID", str(first))]
        return _record("revisit", fields, http)
    return _record("response", fields, http + payload)


def _write(batches: Iterator[pa.RecordBatch], folder: str, given: bytes, level: int, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get(), 0
    data = zstandard.ZstdCompressionDict(given) if given else None
    compressor = zstandard.ZstdCompressor(level=level, dict_data=data)
    rows = ((b, i) for b in batches for i in range(len(b)))
    row = next(rows, None)
    while row is not None:
        name, records, size = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.zst", 0, 0
        with _files.Whole(f"{folder}/{name}") as out:
            if given:
                out.write(struct.pack("<II", MAGIC, len(given)) + given)
            out.write(compressor.compress(_record("warcinfo", [("WARC-Record-ID", _id(None, name)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            while row is not None and size < archive_bytes:
                b, i = row
                payload = (b.column("html")[i].as_py() or "").encode()
                plain = record(b.column("page_id")[i].as_py(), b.column("url")[i].as_py(), payload, b.column("first")[i].as_py(), b.column("revisit")[i].as_py())
                out.write(compressor.compress(plain))
                records, size, row = records + 1, size + len(plain), next(rows, None)
        n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "plain_bytes"])


def write(spark: SparkSession, pages: DataFrame, folder: str, level: int = LEVEL, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; result: archive, records and plain_bytes of each."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html)).alias("digest"))
    firsts = written(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.max(F.octet_length("html")).cast("long").alias("size")), "op6-firsts")
    share = min(1.0, SAMPLE / max(1, firsts.count()))
    few = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("double") < share * 2**32
    sized = firsts.where(few & (F.col("size") <= SAMPLE_BYTES)).withColumn("upto", F.sum("size").over(Window.orderBy("digest")))
    chosen = keyed.join(F.broadcast(sized.where(F.col("upto") <= SAMPLE_BYTES)), "digest")
    some = chosen.groupBy("digest", "first").agg(F.min(F.struct("page_id", "url", "html")).alias("p")).collect()
    given = dictionary([record(x.p.page_id, x.p.url, x.p.html.encode(), x.first, False) for x in sorted(some, key=lambda x: x.digest)])
    large = F.octet_length("html") >= min_revisit
    revisit = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = keyed.join(firsts.drop("size"), "digest").select("page_id", "url", "html", "first", revisit.alias("revisit"))
    return written(rows.mapInArrow(lambda batches: _write(batches, folder, given, level, archive_bytes), "archive string, records long, plain_bytes long"), "op6-archives")


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record of one archive."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic == MAGIC:
        data = zstandard.ZstdCompressionDict(stream.read(size))
    else:
        stream.seek(0)
        data = None
    with io.BufferedReader(zstandard.ZstdDecompressor(dict_data=data).stream_reader(stream, read_across_frames=True), 1 << 20) as plain:
        while line := plain.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {line[:60]!r}")
            fields = {}
            while (line := plain.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                fields[k.lower()] = v
            block = plain.read(int(fields["content-length"]))
            if plain.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut off")
            yield fields, block


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    for b in batches:
        for name in b.column("archive").to_pylist():
            fs, path = _files.at(f"{folder}/{name}")
            rows, held = [], 0
            with fs.open_input_file(path) as f:
                for fields, block in records(f):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    rows.append((None if page is None else int(page), fields.get("warc-target-uri"), payload.decode() if kind == "response" else None, size, digest, kind, None if to is None else int(to), name))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) == 5000:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def read(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """The response and revisit records: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, archive."""
    schema = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(lambda batches: _read(batches, folder), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "op6-warc")
    archives = write(spark, table(spark, sf_dir, "pages"), folder)
    return read(spark, archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
