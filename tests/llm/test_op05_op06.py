import base64
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.errors import AnalysisException

from bitloom.llm import _files, op05_shard, op06_warc


def documents():
    r = random.Random(6)
    rows = [(i, "ä" * r.randrange(200)) for i in range(400)]
    return rows + [(None, None), (None, "x"), (None, "y"), (7, "same"), (7, "same"), (500, ""), (501, "long " * 800), (502, None)]


def test_shards(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op05_shard.query(spark, str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.size, x.text_crc32) for x in out), key=str) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    sizes, places = Counter(), defaultdict(list)
    for x in out:
        assert x.law == "bytes" and x.grown_shard is None
        sizes[x.shard] += x.size
        places[x.shard].append(x.slot)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= max(x.size for x in out)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_growth_only_moves_into_the_new_shard(spark, tmp_path):
    r = random.Random(1)
    sizes = {s: r.randrange(1, 5000) for s in range(2000)}
    now = op05_shard.assign(sizes, 4)
    op05_shard.save(spark, now, 1, f"{tmp_path}/maps")
    for version, shards in ((2, 5), (3, 6)):
        new = op05_shard.grow(now, sizes)
        assert all(new[s] in (now[s], shards - 1) for s in sizes)
        op05_shard.save(spark, new, version, f"{tmp_path}/maps")
        total = Counter()
        for s, k in new.items():
            total[k] += sizes[s]
        assert max(total.values()) < 1.02 * min(total.values())
        now = new
    assert op05_shard.load(spark, f"{tmp_path}/maps") == now
    assert set(op05_shard.load(spark, f"{tmp_path}/maps", 1).values()) == set(range(4))
    with pytest.raises(AnalysisException):
        op05_shard.save(spark, now, 3, f"{tmp_path}/maps")
    assert op05_shard.load(spark, f"{tmp_path}/maps") == now


def test_crowded_slots_are_ranked_in_parts(spark, tmp_path, monkeypatch):
    rows = documents() + [(None, "")] * 60 + [(9, "copy")] * 40
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, size int, part int, rank string").repartition(7)
    monkeypatch.setattr(op05_shard, "CROWDED", 5)
    out = op05_shard.shard(spark, d, shards=3, slots=40).collect()
    places = defaultdict(list)
    for x in out:
        places[x.shard].append(x.place)
    assert len(out) == len(rows) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_plan_is_native(spark, tmp_path):
    spark.createDataFrame(documents(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = op05_shard.query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def pages():
    r = random.Random(8)
    bodies = ["<p>" + "word %d " % i * r.randrange(1, 40) + "</p>" for i in range(40)] + ["", "é" * 1000, "\r\n\r\nWARC/1.1\r\n", "z" * 300000]
    return [(i, f"http://x.org/{i}", r.choice(bodies)) for i in range(150)] + [(200, None, None), (201, "a b\r\nX: y", ""), (None, "u", bodies[0]), (None, "u", "only null"), (202, "u", "only null"), (203, "u", "v"), (203, "u", "v")]


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        f, raw = first.get(h or ""), (h or "").encode()
        revisit = f is not None and p != f
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_archives(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(x) for x in op06_warc.query(spark, str(tmp_path)).collect()), key=str) == brute(rows)
    folder = f"file://{tmp_path}/warc"
    archives = op06_warc.write(spark, spark.read.parquet(f"{tmp_path}/pages.parquet"), folder, archive_bytes=20000)
    assert sorted(x.archive for x in archives.collect()) == [n for n, _ in _files.listed(folder, ".warc.zst")]
    back = {x.page_id: x.payload for x in op06_warc.read(spark, archives, folder).where("record_type = 'response'").collect()}
    assert all(back[p] == (h or "") for p, _, h in rows if p in back and p is not None)
    raw = next(tmp_path.glob("warc/*.zst")).read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == op06_warc.MAGIC
    dctx, at, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])), 8 + size, 0
    while at < len(raw):  # each record is a frame of its own
        d = dctx.decompressobj()
        assert d.decompress(raw[at:]).startswith(b"WARC/1.1\r\n")
        at, n = len(raw) - len(d.unused_data), n + 1
    assert n > 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op06_warc.query(spark, str(tmp_path)).collect() == []
    assert op05_shard.query(spark, str(tmp_path)).collect() == []


def test_dictionary_learns_whole_records_of_different_payloads(spark, tmp_path, monkeypatch):
    rows = [(k, f"http://x.org/{k}", "same" if k % 3 else f"{k} " + "long " * 5000) for k in range(60)]
    seen = []
    monkeypatch.setattr(op06_warc, "dictionary", lambda samples: seen.extend(samples) or b"")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    op06_warc.write(spark, pages, f"file://{tmp_path}/warc")
    assert sorted(seen) == sorted(op06_warc.record(p, u, h.encode(), p, False) for p, u, h in rows if p % 3 == 0 or p == 1)


def test_pages_with_clashing_columns(spark, tmp_path):
    rows = [(p, u, h, "d", p, "r") for p, u, h in pages()]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first long, archive string")
    archives = op06_warc.write(spark, d, f"file://{tmp_path}/warc")
    assert op06_warc.read(spark, archives, f"file://{tmp_path}/warc").count() == len(rows)
